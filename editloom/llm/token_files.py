"""Token ids of whole texts in Parquet files that can be read in part.

A file set is a folder with ``data`` (part, doc_id, local_start, n_tokens, tokens as a list column) in ascending doc_id
order from file to file and row to row, and ``manifest`` (part, base, documents, tokens), one row per file part. A
document starts at the base of its part plus its local start, so no second pass over the ids is needed to number them.
Ids are dictionary-encoded, the other columns delta-encoded; row groups and pages are small, and pages carry column
indexes, so a reader takes the metadata alone, or only the pages of the documents it asks for."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_of, key_of, pass_rows, prepare, text_of
from .tokens import END, default_path, encoder, in_parts

_ROWS = "part int, key long, local_start long, n_tokens long, tokens array<int>"


@dataclass(frozen=True)
class Layout:
    """Bytes of a row group and of a page, and the compression of pages."""
    row_group: int = 32 << 20
    page: int = 64 << 10
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        return {"compression": self.codec, "parquet.block.size": str(self.row_group), "parquet.page.size": str(self.page),
                "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false",
                "parquet.enable.dictionary#tokens.list.element": "true"}


def _list_array(blobs: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(blobs) + 1, np.int32)
    np.cumsum([len(b) // 4 for b in blobs], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), "<i4")))


def _encode_part(path: str, end: int):
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext
        part, at, encode = TaskContext.get().partitionId(), 0, encoder(path).encode
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in in_parts(texts):
                blobs = [x + last for x in encode(texts[a:b])]
                counts = np.array([len(x) // 4 for x in blobs], np.int64)
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.record_batch({"part": pa.array(np.full(b - a, part, np.int32)), "key": batch["key"].slice(a, b - a), "local_start": pa.array(starts),
                                       "n_tokens": pa.array(counts), "tokens": _list_array(blobs)})
    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END, layout: Layout = Layout()) -> None:
    """Encode every text and write the file set. Null texts are empty: one end id. Rows without doc_id come last.

    Only the counts of the file parts reach the driver."""
    spark = docs.sparkSession
    prepare(spark)
    rows = pass_rows(docs, {"key": key_of(), "text": text_of()}).repartitionByRange("key").sortWithinPartitions("key")
    coded = rows.mapInArrow(_encode_part(vocabulary or default_path(), end), _ROWS)
    data = coded.select("part", id_of(F.col("key")).alias("doc_id"), "local_start", "n_tokens", "tokens")
    data.write.options(**layout.options()).parquet(f"{path}/data")
    parts = spark.read.parquet(f"{path}/data").groupBy("part").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    counts = sorted(tuple(r) for r in parts.collect())
    manifest, base = [], 0
    for part, documents, tokens in counts:
        manifest.append((part, base, documents, tokens))
        base += tokens
    spark.createDataFrame(manifest, "part int, base long, documents long, tokens long").coalesce(1).write.parquet(f"{path}/manifest")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, part) without touching any token page."""
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "base")  # one row per file part
    rows = spark.read.parquet(f"{path}/data").select("part", "doc_id", "local_start", "n_tokens")
    return rows.join(F.broadcast(manifest), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "part")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, tokens), all documents or those with low <= doc_id <= high; the bounds prune row groups and pages."""
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "base")
    rows = spark.read.parquet(f"{path}/data")
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows.join(F.broadcast(manifest), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def _digest(batches):
    for batch in batches:
        lists = batch["tokens"]
        offsets, raw = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.record_batch({"doc_id": batch["doc_id"], "start": batch["start"], "n_tokens": batch["n_tokens"], "ids_crc32": pa.array(sums, pa.int64())})


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what :func:`read_tokens` gives."""
    return tokens.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
