"""Token ids of whole texts by a public tokenizer file, with each distinct word encoded once per worker.

The vocabulary splits texts at white space and never lets a token cross it, so the ids of a text are the ids of its
white-space chunks one after the other; a chunk of letters and closing marks is again the letters, then the marks."""

from __future__ import annotations

import os
import threading

import numpy as np

#: The vocabulary file by default; its path is a parameter everywhere.
VOCABULARY = "word_bpe_49k.json"
#: Id that ends each document.
END = 1
#: Distinct chunks, and distinct pieces of them, in one of the two generations that a worker keeps.
KEPT_CHUNKS = 180_000
KEPT_PIECES = 225_000

# Bytes of a plain word: ASCII letters, and the lead byte of À to ÿ with its second bytes, but for those of × and ÷.
# Their lower case is one letter, and no composition changes them.
_PLAIN = bytes(range(65, 91)) + bytes(range(97, 123)) + b"\xc3" + bytes(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7))
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BLOCK = 512


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


class Kept:
    """Ids of what was met, in two generations of bounded size: a full one becomes the old one, from which only what is met
    again comes back, so frequent words outlive rare ones."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def missing(self, need: set) -> set:
        """Those of ``need`` that must be encoded; all others are in the young generation afterwards."""
        new = need.difference(self.young)
        if len(self.young) + len(new) > self.most:
            self.old, self.young, new = self.young, {}, need
        back = {x: self.old[x] for x in new if x in self.old}
        self.young.update(back)
        return new.difference(back)


class Encoder:
    """Encodes lists of texts into little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.chunks, self.pieces = Kept(KEPT_CHUNKS), Kept(KEPT_PIECES)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces that are one token run each: many in one text, cut after the ids that end a word."""
        for k in range(0, len(pieces), _BLOCK):
            part = pieces[k:k + _BLOCK]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                self.pieces.young.update(zip(map(str.encode, part), self._whole(part)))
                continue
            raw, at = ids.tobytes(), 0
            for piece, cut in zip(part, (cuts * 4).tolist()):
                self.pieces.young[piece.encode()] = raw[at:cut]
                at = cut

    def _encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        words = [c.rstrip(_MARKS) for c in chunks]
        words = [w if w and not w.translate(None, _PLAIN) else b"" for w in words]
        lower = [w if w.isascii() and w.islower() else w.decode().lower().encode() for w in words]
        marks = [c[len(w):] for c, w in zip(chunks, words)]
        odd = [m.decode() for w, m in zip(words, marks) if not w]
        need = set(lower)
        need.update(m for w, m in zip(words, marks) if w)
        need.discard(b"")
        self._learn([p.decode() for p in self.pieces.missing(need)])
        others = iter(self._whole(odd)) if odd else iter(())
        get = self.pieces.young.__getitem__
        return [(get(w) + get(m) if m else get(w)) if w else next(others) for w, m in zip(lower, marks)]

    def _chunks_of(self, text: str | None) -> list[bytes]:
        """White-space chunks, ASCII letters in lower case: the vocabulary lowers them anyway. Where letter case could make
        or unmake a special token, it is left as it is."""
        raw = (text or "").encode()
        low = raw.lower()
        return (raw if any(x in low for x in self.special) else low).split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        chunks = [self._chunks_of(t) for t in texts]
        new = list(self.chunks.missing(set().union(*chunks)))
        if new:
            self.chunks.young.update(zip(new, self._encode_chunks(new)))
        get = self.chunks.young.__getitem__
        return [b"".join(map(get, c)) for c in chunks]


def release() -> None:
    """Drop what this worker's encoders keep; steps that follow the encoding call it."""
    for held in _ENCODERS.values():
        held.chunks.clear()
        held.pieces.clear()


_ENCODERS: dict[str, Encoder] = {}
_LOCK = threading.Lock()


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    with _LOCK:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]


def in_parts(texts: list[str | None], most: int = 2_000_000):
    """Slices of a list whose texts hold about so many characters, so a batch of long texts stays small in memory."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
