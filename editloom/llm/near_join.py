"""N-gram Jaccard self-join by chosen paths.

A document is the set of its five-word shingles, and equal sets are one set with a number of copies. For splitting, a
set is embedded as 64 tokens, its minima under 64 hash functions, of which two sets share a fraction close to their
Jaccard similarity. A run starts all sets on one sampled token; a bucket is the sets that share all tokens of a path. A
bucket that is small is compared by brute force; a larger one is split on further sampled tokens, again and again: twice
on three tokens at once, so that a pair at the threshold stays together in about one (2 * 0.8^3) of a path's children and
the rows at most double in a round. Sets that resemble the first of their bucket are linked with it, each by itself; those that are nearly
equal to it are done, as the first stands for them, and a bucket of mostly similar sets is not split at all. Runs are repeated until a pair
at the threshold is found with the target recall: a few for all sets, as a pair in small buckets needs only one token in
common, and more for the sets of which a bucket was split.

What the buckets propose forms candidate groups. All pairs of a group are then compared exactly, each set read once: large
groups are cut into blocks, and each pair of blocks is one piece of work. A piece returns counts and a spanning
forest, never its pairs, so a group of thousands of similar texts gives rows in proportion to its members."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, connected, gram_hashes, hash_of_text, hash_words, id_of, key_of, mix, pass_rows, prepare, stage, text_of, tidied

SHINGLE = 5
THRESHOLD = 0.8
#: Tokens of the embedding; sets in a small bucket are candidates from this share of equal tokens (four deviations below the threshold).
TOKENS = 64
CANDIDATE = 0.6
#: Tokens of a split, and splits of a bucket: of a pair at the threshold 2 * 0.8^3 = 1.02 paths are expected to go on.
STEP, SPLITS = 3, 2
#: Recall that the runs reach for pairs at the threshold.
RECALL = 0.9999
#: Largest bucket for brute force on the tokens, and splits of one path; what is still large then is compared exactly.
LEAF = 256
DEPTH = 5
#: Share of tokens in common with a bucket's first set from which a set is linked with it; also the mean share from which a bucket is not split.
DENSE = 0.6
#: Share from which a set is not split on: what it has 0.65 of its tokens in common with (three deviations below the threshold) has
#: 0.6 in common with the first, as shares of unlike tokens add up at most, so all partners of the set are linked with the first as well.
SAME = 0.95
#: Sets, and shingles, of one block in the exact comparison.
BLOCK_SETS = 200
BLOCK_SHINGLES = 200_000
#: Large buckets, with the tokens of their first sets, that may be broadcast; more are joined by shuffle.
BROADCAST_BUCKETS = 50_000
#: Members of candidate groups that may be broadcast to find their texts; more are joined by shuffle.
BROADCAST_MEMBERS = 300_000

_A = (mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, TOKENS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def found_in_run(threshold: float = THRESHOLD) -> float:
    """The chance that one run keeps a pair at the threshold together down to the last depth."""
    alive = 1.0
    for _ in range(DEPTH):
        alive = 1 - (1 - threshold ** STEP * alive) ** SPLITS
    return threshold * alive


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Runs of all sets, and runs in total of sets of which a bucket was split; each run starts on a token of its own.

    A pair is lost when it shares the first token of no run of all sets, or when it is parted by splits in all runs: each
    may take half of what the recall leaves. A pair that shares a first token is found there or has both sets split."""
    half = math.log((1 - recall) / 2)
    few, all_runs = (math.ceil(half / math.log(1 - p)) for p in (threshold, found_in_run(threshold)))
    if all_runs > TOKENS:
        raise ValueError(f"{all_runs} runs need more than {TOKENS} tokens")
    return few, all_runs


def shingles(text: str, known: dict[str, int], n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of fewer than n words, one shingle of them all; of no words, none."""
    return np.unique(gram_hashes(hash_words(WORD.findall(text.lower()), known), n))


def embed(grams: np.ndarray) -> np.ndarray:
    """The 64 minima of a set under the hash functions."""
    short = (mix(grams) >> np.uint64(32)).astype(np.uint32)
    best = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(short), 2048):
        np.minimum(best, (short[k:k + 2048, None] * _A + _B).min(axis=0), out=best)
    return best


def set_hash(grams: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    with np.errstate(over="ignore"):
        return np.array([mix(grams).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(grams + np.uint64(7)))], np.uint64).tobytes()


def _sketch(n: int):
    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            sizes, hashes, tokens = [], [], []
            for text in batch["text"].to_pylist():
                grams = shingles(text, known, n)
                sizes.append(len(grams))
                hashes.append(set_hash(grams) if len(grams) else None)
                tokens.append(embed(grams).tobytes() if len(grams) else None)
            yield pa.record_batch({"key": batch["key"], "text_hash": batch["text_hash"], "n": pa.array(sizes, pa.int32()), "hash": pa.array(hashes, pa.binary()), "tokens": pa.array(tokens, pa.binary())})
    return run


def _tokens_of(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch["tokens"].to_pylist()), np.uint32).reshape(batch.num_rows, TOKENS)


def _paths(path: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(path + coordinate.astype(np.uint64)) ^ (value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _roots(runs: range):
    """First tokens: run r samples coordinate r."""
    def run(batches):
        for batch in batches:
            tokens, sid = _tokens_of(batch), batch["sid"].to_numpy()
            for r in runs:
                path = _paths(np.full(len(sid), r, np.uint64), np.full(len(sid), r), tokens[:, r])
                yield pa.record_batch({"path": pa.array(path.view(np.int64)), "sid": pa.array(sid)})
    return run


def _children(batches):
    """SPLITS further paths for each row, each on STEP sampled tokens; all rows of a path sample the same tokens."""
    for batch in batches:
        tokens, sid, path = _tokens_of(batch), batch["sid"].to_numpy(), batch["path"].to_numpy().view(np.uint64)
        rows = np.arange(len(sid))
        for split in range(SPLITS):
            child = path + np.uint64(split)
            for step in range(STEP):
                at = (mix(path + np.uint64(1 + split * STEP + step)) % np.uint64(TOKENS)).astype(np.int64)
                child = _paths(child, at, tokens[rows, at])
            yield pa.record_batch({"path": pa.array(child.view(np.int64)), "sid": pa.array(sid)})


def _likeness(batches):
    """Share of tokens that each set of a bucket has in common with the bucket's first set."""
    for batch in batches:
        other = np.frombuffer(b"".join(batch["first"].to_pylist()), np.uint32).reshape(batch.num_rows, TOKENS)
        yield pa.record_batch({**{c: batch[c] for c in ("path", "sid", "low", "tokens")}, "share": pa.array((_tokens_of(batch) == other).mean(axis=1))})


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes is linked with over the pairs (left, right)."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _leaf_edges(batches):
    """Candidate links of small buckets as (set, smallest set of its local component)."""
    for batch in batches:
        a, b = [], []
        lists, members = batch["members"], batch["members"].values
        offsets, sids = lists.offsets.to_numpy(), members.field("sid").to_numpy()
        tokens = np.frombuffer(b"".join(members.field("tokens").to_pylist()), np.uint32).reshape(len(sids), TOKENS)
        for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            own = tokens[low:high]
            if high - low == 2:
                if (own[0] == own[1]).mean() >= CANDIDATE:
                    a.append(sids[low])
                    b.append(sids[low + 1])
                continue
            order = np.argsort(sids[low:high])
            own, names = own[order], sids[low:high][order]
            near = [np.flatnonzero((own[i + 1:] == own[i]).mean(axis=1) >= CANDIDATE) + i + 1 for i in range(len(own) - 1)]
            root = _forest(len(own), np.repeat(np.arange(len(near)), [len(x) for x in near]), np.concatenate(near))
            moved = np.flatnonzero(root != np.arange(len(root)))
            a.extend(names[moved])
            b.extend(names[root[moved]])
        yield pa.record_batch({"a": pa.array(np.array(a, np.int64)), "b": pa.array(np.array(b, np.int64))})


def distinct_sets(sketches: DataFrame) -> DataFrame:
    """(sid, low, hash, n, copies, tokens): one row per distinct set that has shingles; sid comes from the set's hash, low is
    the first (key, text_hash) of its documents."""
    return (sketches.where("n > 0").groupBy("hash").agg(F.min(F.struct("key", "text_hash")).alias("low"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
            .withColumn("sid", F.xxhash64("hash")))


def candidate_edges(sets: DataFrame, runs: tuple[int, int]) -> DataFrame:
    """(a, b) candidate links from all runs."""
    tokens = sets.select("sid", "tokens")
    few, all_runs = runs
    rows = stage(tokens.mapInArrow(_roots(range(few)), "path long, sid long"), "join-paths")
    edges = None
    for depth in range(DEPTH + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("size"), F.min("sid").alias("low"))
        large = stage(sizes.where(F.col("size") > LEAF).select("path", "low"), "join-large")
        number = large.limit(BROADCAST_BUCKETS + 1).count()
        beside = F.broadcast if number <= BROADCAST_BUCKETS else (lambda df: df)
        small = rows.join(beside(large.select("path")), "path", "left_anti") if number else rows
        shared_paths = small.groupBy("path").agg(F.collect_list("sid").alias("sids")).where(F.size("sids") > 1)
        leaves = shared_paths.select("path", F.explode("sids").alias("sid")).join(tokens, "sid")
        buckets = leaves.groupBy("path").agg(F.collect_list(F.struct("sid", "tokens")).alias("members")).select("members")
        found = [buckets.mapInArrow(_leaf_edges, "a long, b long")]
        if number == 0:
            rows = None
        elif depth == DEPTH:
            found.append(rows.join(beside(large), "path").select(F.col("sid").alias("a"), F.col("low").alias("b")))
            rows = None
        else:
            firsts = stage(large.join(tokens, F.col("sid") == F.col("low")).select("path", "low", F.col("tokens").alias("first")), "join-firsts")
            held = rows.join(beside(firsts), "path").join(tokens, "sid")
            likes = stage(held.select("path", "sid", "low", "tokens", "first")
                          .mapInArrow(_likeness, "path long, sid long, low long, tokens binary, share double"), "join-likeness")
            dense = stage(likes.groupBy("path").agg((F.avg("share") >= DENSE).alias("dense")), "join-dense")
            marked = stage(likes.join(beside(dense), "path"), "join-marked")
            found.append(marked.where(F.col("dense") | (F.col("share") >= DENSE)).select(F.col("sid").alias("a"), F.col("low").alias("b")))
            parted = marked.where(~F.col("dense") & (F.col("share") < SAME))
            further = parted.select("path", "sid", "tokens").mapInArrow(_children, "path long, sid long")
            if depth == 0:
                again = tokens.join(parted.select("sid").distinct(), "sid", "left_semi")
                further = further.unionByName(again.mapInArrow(_roots(range(few, all_runs)), "path long, sid long"))
            rows = stage(further, "join-paths")
        for part in found:
            edges = part if edges is None else edges.unionByName(part)
        if rows is None:
            return edges
    raise AssertionError("the last depth ends the loop")


def _grams(n: int):
    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            made = [shingles(t, known, n) for t in batch["text"].to_pylist()]
            same = [set_hash(g) == h for g, h in zip(made, batch["hash"].to_pylist())]
            kept = batch.filter(pa.array(same, pa.bool_()))
            grams = pa.array([g.tobytes() for g, s in zip(made, same) if s], pa.binary())
            yield pa.record_batch({**{c: kept[c] for c in ("sid", "root", "block", "blocks", "copies")}, "grams": grams})
    return run


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    every = np.concatenate(sets)
    names, at = np.unique(every, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = np.bincount(at, minlength=len(names)) > 1
    number = np.cumsum(common) - 1
    keep = common[at]
    at, owner = number[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    for low in range(0, int(common.sum()), width):
        a, b = np.searchsorted(at, [low, low + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], at[a:b] - low] = 1
        out += part @ part.T
    return out


def _exact(threshold: float):
    """Links of one piece of work: per set the copies it is linked with, and the smallest set of its local component."""
    def run(batches):
        for batch in batches:
            out = []
            for one, members in zip(batch["single"].to_pylist(), batch["members"]):
                rows = {m["sid"]: m for m in members.as_py()}
                names = sorted(rows)
                if len(names) < 2:
                    continue
                sets = [np.frombuffer(rows[s]["grams"], np.uint64) for s in names]
                size = np.array([len(s) for s in sets], np.float64)
                both = shared(sets)
                linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
                block = np.array([rows[s]["block"] for s in names])
                if not one:
                    linked &= block[:, None] != block[None, :]
                np.fill_diagonal(linked, False)
                copies = np.array([rows[s]["copies"] for s in names], np.int64)
                left, right = np.nonzero(np.triu(linked))
                root = _forest(len(names), left, right)
                links = linked @ copies
                out.extend((names[i], int(links[i]), names[root[i]]) for i in np.flatnonzero(links).tolist())
            columns = list(zip(*out)) or [()] * 3
            yield pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(("sid", "links", "low"), columns)})
    return run


def exact_links(docs: DataFrame, sets: DataFrame, groups: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(sid, links, low): all pairs within each candidate group (node, root), compared exactly."""
    members = groups.join(sets.select(F.col("sid").alias("node"), "low", "n", "copies", "hash"), "node")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(sizes, "root").select("low.key", "low.text_hash", F.col("node").alias("sid"), "root", "hash", "copies", "blocks",
                                                F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    placed = stage(placed, "join-members")
    small = placed.limit(BROADCAST_MEMBERS + 1).count() <= BROADCAST_MEMBERS
    texts = pass_rows(docs, {"key": key_of(), "text_hash": hash_of_text(), "text": text_of()}).join(F.broadcast(placed) if small else placed, ["key", "text_hash"])
    grams = texts.select("sid", "root", "hash", "copies", "blocks", "block", "text").mapInArrow(
        tidied(_grams(n)), "sid long, root long, block int, blocks int, copies long, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pieces = grams.select("*", other.alias("other")).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    work = pieces.groupBy("root", "i", "j").agg(F.collect_list(F.struct("sid", "block", "copies", "grams")).alias("members"))
    return work.select((F.col("i") == F.col("j")).alias("single"), "members").mapInArrow(tidied(_exact(threshold)), "sid long, links long, low long")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(key, text_hash, class_key, first, links) of every row: class_key is the smallest key that the row is linked with through
    any chain; first tells the row that stays of its class, of rows with that key the one of the smallest text_hash.

    ``links`` counts the other documents whose similarity reaches the threshold, copies included. Documents of fewer than
    n words are one shingle of all their words; those without words (null and empty texts too) are linked with nothing.
    Rows that repeat a doc_id with equal words are copies; with other words, they are documents of the same key."""
    prepare(docs.sparkSession)
    sketches = stage(pass_rows(docs, {"key": key_of(), "text_hash": hash_of_text(), "text": text_of()}).mapInArrow(tidied(_sketch(n)), "key long, text_hash long, n int, hash binary, tokens binary"), "join-sketches")
    sets = stage(distinct_sets(sketches), "join-sets")
    groups = connected(candidate_edges(sets, runs_for(recall, threshold)), "join-groups")
    links = stage(exact_links(docs, sets, groups, n, threshold), "join-links")
    classes = connected(links.select(F.col("sid").alias("a"), F.col("low").alias("b")), "join-classes")
    counts = links.groupBy("sid").agg(F.sum("links").alias("links"))
    linked = classes.select(F.col("node").alias("sid"), "root").join(sets.select("sid", "low"), "sid")
    lows = linked.groupBy("root").agg(F.min("low").alias("least"))
    least = linked.select("sid", "root").join(lows, "root").select("sid", "least")
    known = (sets.select("sid", "hash", "copies", "low").join(least, "sid", "left").join(counts, "sid", "left")
             .select("hash", F.coalesce("least", "low").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    return (sketches.select("key", "text_hash", "hash").join(known, "hash", "left")
            .select("key", "text_hash", F.coalesce("least.key", "key").alias("class_key"),
                    F.coalesce(F.col("least") == F.struct("key", "text_hash"), F.lit(True)).alias("first"), F.coalesce("links", F.lit(0)).cast("long").alias("links")))


def classes_of(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) of :func:`near_duplicates`; class_id is null in a class of rows without doc_id."""
    rows = near_duplicates(docs, n, threshold, recall)
    return rows.select(id_of(F.col("key")).alias("doc_id"), id_of(F.col("class_key")).alias("class_id"), F.col("links").alias("n_links"))
