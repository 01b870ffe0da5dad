"""Exact dedup with a minimal perfect hash over the distinct digests of earlier documents.

The index is cut into shards by digest. A shard is a ladder of bit levels: a key settles on the first level where no
other key falls on its bit, and its slot is the number of set bits before it, so n keys fill the slots 0..n-1 without
gaps. Each slot holds the full digest, and the locator (length and id) of the row that stays for it. A lookup walks the
levels, reads one slot and compares all bytes of the digest; what is not in the index is grouped by digest on its own.

Rows of one text are merged before any shuffle, so one text with a third of all rows is one row per task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, hash_of_text, id_of, key_of, pass_rows, prepare, stage, text_of

#: Characters that do not count when texts are compared.
SPACE = r"[\x20\x09-\x0D]"
#: Bits per key on a level of the hash.
GAMMA = 2
#: Digests that a shard of the index holds on average.
SHARD_KEYS = 20_000

_SHARD_TYPE = "shard int, levels array<binary>, digests binary, lengths array<int>, ids array<long>, counts array<long>"


def _positions(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit of each digest (rows of four unsigned words) on a level."""
    with np.errstate(over="ignore"):
        x = words[:, level % 4] + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(bits)).astype(np.int64)


def build_levels(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit levels over distinct 32-byte digests (rows of four words), and the slot of each digest."""
    levels, slots, left, base = [], np.zeros(len(digests), np.int64), np.arange(len(digests)), 0
    while len(left):
        bits = max(8, GAMMA * len(left) + 7 & ~7)
        at = _positions(digests[left], len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        settled = alone[at]
        slots[left[settled]] = base + np.cumsum(alone)[at[settled]] - 1
        base += int(settled.sum())
        levels.append(np.packbits(alone))
        left = left[~settled]
    return levels, slots


def find_slots(levels: list[bytes], digests: np.ndarray) -> np.ndarray:
    """Slot that each digest would have, -1 where no level has its bit. Members always get their own slot."""
    out, left, base = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for k, packed in enumerate(levels):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        at = _positions(digests[left], k, len(bits))
        hit = bits[at]
        out[left[hit]] = base + np.cumsum(bits)[at[hit]] - 1
        base += int(bits.sum())
        left = left[~hit]
    return out


def _as_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(len(digests), 4)


def _build(key, rows):
    digests = rows["digest"].to_pylist()
    levels, slots = build_levels(_as_words(digests))
    order = np.empty(len(slots), np.int64)
    order[slots] = np.arange(len(slots))
    take = rows.take(pa.array(order))
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary())),
        "digests": pa.array([b"".join(take["digest"].to_pylist())], pa.binary()),
        "lengths": pa.array([take["length"].to_pylist()], pa.list_(pa.int32())), "ids": pa.array([take["id"].to_pylist()], pa.list_(pa.int64())),
        "counts": pa.array([take["count"].to_pylist()], pa.list_(pa.int64()))})


def _probe(key, rows, shard):
    digests = rows["digest"].to_pylist()
    n = len(digests)
    length, ident, count = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if shard.num_rows and n:
        row = shard.to_pylist()[0]
        slots = find_slots(row["levels"], _as_words(digests))
        held = row["digests"]
        same = np.array([s >= 0 and held[32 * s:32 * s + 32] == d for s, d in zip(slots.tolist(), digests)], bool)
        for out, name in ((length, "lengths"), (ident, "ids"), (count, "counts")):
            out[same] = np.asarray(row[name], out.dtype)[slots[same]]
    return pa.table({"digest": rows["digest"], "length": rows["length"], "id": rows["id"], "count": rows["count"],
                     "old_length": pa.array(length), "old_id": pa.array(ident), "old_count": pa.array(count)})


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text_hash, digest, length): digest of the text without white space, length in code points of the text as it is."""
    return pass_rows(docs, {"doc_id": F.col("doc_id"), "key": key_of(), "text_hash": hash_of_text(), "digest": F.unhex(F.sha2(F.regexp_replace(text_of(), SPACE, ""), 256)),
                            "length": F.length(text_of())})


def distinct_digests(rows: DataFrame) -> DataFrame:
    """(digest, length, id, count): the row that stays of each digest is the longest, then the one with the smallest key."""
    best = F.max(F.struct("length", (-F.col("key")).alias("low")))
    return (rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("count"))
            .select("digest", F.col("best.length").alias("length"), (-F.col("best.low")).alias("id"), "count"))


def _sharded(distinct: DataFrame, shards: int) -> DataFrame:
    return distinct.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the bit levels, and in slot order the digests and the locators of the rows that stay."""
    return _sharded(distinct, shards).groupBy("shard").applyInArrow(_build, _SHARD_TYPE)


def lookup(distinct: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Adds old_length, old_id and old_count of the indexed digest; old_count is 0 for digests that the index lacks."""
    schema = "digest binary, length int, id long, count long, old_length int, old_id long, old_count long"
    probes = _sharded(distinct, shards).groupBy("shard")
    return probes.cogroup(index.groupBy("shard")).applyInArrow(_probe, schema)


def exact_dedup(new: DataFrame, old: DataFrame) -> DataFrame:
    """Dedup of ``new`` rows against ``old`` ones and each other; both as :func:`digest_rows` gives them.

    Returns one row per row of both: doc_id, key, keep_id, group_size, kept, text_sha256. Texts are equal when they are the
    same without white space; null is the empty text, and empty texts are equal. The longest text stays, then the
    smallest doc_id. Rows that repeat a doc_id with equal texts count as one document: all of them are kept or dropped
    together. Rows without doc_id are told apart by text, rank after all others of equal length, and have a null keep_id
    when they stay."""
    prepare(new.sparkSession)
    first, second = distinct_digests(old), distinct_digests(new)
    first = stage(first, "digests-old")
    shards = max(1, -(-first.count() // SHARD_KEYS))
    index = stage(build_index(first, shards), "digest-index")
    found = stage(lookup(second, index, shards), "digest-lookup")
    longer = "old_count > 0 and (old_length > length or (old_length = length and old_id < id))"
    seen = found.where("old_count > 0").select(
        "digest", F.when(F.expr(longer), F.col("old_id")).otherwise(F.col("id")).alias("keep"), (F.col("count") + F.col("old_count")).alias("size"))
    fresh = found.where("old_count = 0").select("digest", F.col("id").alias("keep"), F.col("count").alias("size"))
    gone = first.join(seen.select("digest"), "digest", "left_anti").select("digest", F.col("id").alias("keep"), F.col("count").alias("size"))
    groups = seen.unionByName(fresh).unionByName(gone)
    return new.unionByName(old).join(groups, "digest").select(
        "doc_id", "key", "text_hash", id_of(F.col("keep")).alias("keep_id"), F.col("size").alias("group_size"), (F.col("key") == F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def dedup_keys(docs: DataFrame) -> DataFrame:
    """Exact dedup of a whole table: its older half by id is indexed as history, the newer half is looked up in it."""
    rows = stage(digest_rows(docs), "digests")
    low, high = rows.where(F.col("key") < NO_ID).agg(F.min("key"), F.max("key")).first()
    middle = ((low or 0) + (high or 0)) // 2
    return exact_dedup(rows.where(F.col("key") > middle), rows.where(F.col("key") <= middle))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``; see :func:`exact_dedup`."""
    return dedup_keys(docs).drop("key", "text_hash")
