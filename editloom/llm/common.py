"""What the corpus operators share: keys, staged tables, words."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editloom.session import staging_folder

#: Words for shingles and seeds: letters, digits and underscores, lower-cased.
WORD = re.compile(r"\w+")
#: Rows of ids (24 bytes each) that may be broadcast; longer lists are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Keys from here on belong to rows without doc_id, so these rank after all others.
NO_ID = 1 << 62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = staging_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key that every read of the table gives again: the doc_id, or for rows without one NO_ID plus a hash of the text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.shiftrightunsigned(F.xxhash64(text_of(text)), 2) + F.lit(NO_ID))


def hash_of_text(text: str = "text") -> Column:
    """With the key, what tells apart rows that share a doc_id and have different texts."""
    return F.xxhash64(text_of(text))


def id_of(key: Column) -> Column:
    """The doc_id behind a key; null for rows without one."""
    return F.when(key < NO_ID, key)


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def pass_rows(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Only the named columns, computed from ``docs``; clashing or extra columns are left behind."""
    return docs.select(*[c.alias(n) for n, c in columns.items()])


def connected(edges: DataFrame, name: str = "components", rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of the component.

    Alternates large-star and small-star steps. Each round is written to the shared folder; only its row count and
    checksum reach the driver."""
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, seen = stage(both, name), None
    for _ in range(rounds):
        two_way = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = two_way.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = two_way.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = stage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession, rows: int = 250) -> None:
    """Before a step in Python: fewer rows per Arrow batch than by default, as one row here is a whole text.

    In a local session the workers also get this package; on a cluster it is installed, or sent with --py-files."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    context = spark.sparkContext
    if context.master.startswith("local[") and context.applicationId not in _SHIPPED:
        context.addFile(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), recursive=True)
        _SHIPPED.add(context.applicationId)


def without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not in ``drop`` (key, text_hash), a staged table of distinct rows; all columns are kept.

    A list of at most BROADCAST_IDS rows is broadcast, so no text is moved; a longer one is joined by shuffle."""
    mark = ["__key", "__hash"]
    small = drop.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    keys = drop.select(F.col("key").alias(mark[0]), F.col("text_hash").alias(mark[1]))
    return docs.withColumns({mark[0]: key_of(), mark[1]: hash_of_text()}).join(F.broadcast(keys) if small else keys, mark, "left_anti").select(*docs.columns)


def tidy() -> None:
    """Give freed memory of this worker back to the system, as the next task may need it elsewhere."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidied(step):
    """A batch function that tidies up when its task ends."""
    def run(batches):
        try:
            yield from step(batches)
        finally:
            tidy()
    return run


def hash_words(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; ``known`` keeps those met before and is emptied when it grows large."""
    if len(known) > 250_000:
        known.clear()
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; of fewer words, the one hash of all of them; of no words, none."""
    if not len(hashes):
        return hashes
    n, out = min(n, len(hashes)), None
    with np.errstate(over="ignore"):
        for k in range(n):
            part = hashes[k:len(hashes) - n + 1 + k]
            out = mix(part + np.uint64(n)) if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out
