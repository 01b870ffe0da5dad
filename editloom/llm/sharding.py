"""Shards on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``nodes`` points of a ring; a row starts at the place of its doc_id and goes to the shard of the next point
clockwise. Rows come in the order of a hash priority. A shard that has reached its capacity is full: later rows that meet
its points continue clockwise to the next shard that is not. So the result is that of one pass over all rows in priority
order, whatever their order in the table, and only rows after a filling move.

A shard fills once, so all of the pass that matters is at which priority each shard fills: at most ``shards`` moments. They
are found from counts by ring place and priority prefix (a table of fixed size), read in full only within a prefix where a
shard fills. Every row's shard then is a matter of its own columns and a table of (shards + 1) x PLACES rows.

Nulls: a null text is empty; a row without doc_id has the place of its text's hash. Empty tables give empty shards.
Rows that share doc_id and text are numbered and are rows of their own; rows of one doc_id with other texts share a place
and have priorities of their own. Own columns called ``shard`` or ``slot`` are replaced, all others are kept."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_of_text, key_of, stage, text_of

#: Places of the ring; the start of each lies between two virtual nodes.
PLACES = 1024
#: Bits of a priority, and how many of them one table of counts tells apart.
BITS, STEP = 62, 8
#: Rows of one priority prefix that are read by the driver; a fuller prefix is counted by its next bits first.
READ = 100_000
#: Rows per stretch of a shard, which is what one sort holds.
STRETCH = 20_000
#: Copies of one row that are numbered together.
BLOCK = 100_000


@dataclass(frozen=True)
class Ring:
    """``shards`` shards with ``nodes`` virtual nodes each. A further shard adds its own points and moves no other."""
    shards: int = 8
    nodes: int = 64

    def points(self) -> list[tuple[int, int]]:
        return sorted((xxhash.xxh3_64_intdigest(f"{s}/{i}"), s) for s in range(self.shards) for i in range(self.nodes))

    def owners(self, full: set[int]) -> list[int]:
        """The shard of each place when those of ``full`` take no more; the last shard to fill keeps what comes later."""
        free = [(at, s) for at, s in self.points() if s not in full] or self.points()
        out, k = [], 0
        for place in range(PLACES):
            start = place * (1 << 64) // PLACES
            while k < len(free) and free[k][0] < start:
                k += 1
            out.append(free[k % len(free)][1])
        return out


@dataclass
class Layout:
    """A ring, the capacity of each shard, and the fillings in order: (priority, second priority, shard)."""
    ring: Ring
    capacity: list[int]
    fills: list[tuple[int, int, int]] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        """(era, place, shard): the shard of a place after so many fillings."""
        rows, full = [], set()
        for era in range(len(self.fills) + 1):
            rows += [(era, place, s) for place, s in enumerate(self.ring.owners(full))]
            full |= {s for _, _, s in self.fills[era:era + 1]}
        return spark.createDataFrame(rows, "__era int, __place int, __shard int")

    def era(self) -> Column:
        """Fillings before a row; the row that fills a shard still belongs to it."""
        after = lambda p, q: (F.col("__p") > p) | ((F.col("__p") == p) & (F.col("__q") > q))
        return sum((after(p, q).cast("int") for p, q, _ in self.fills), F.lit(0))


def _ranked(df: DataFrame) -> DataFrame:
    """Add place and priorities to rows with __key, __hash and __copy."""
    own = [F.col(c) for c in ("__key", "__hash", "__copy")]
    return df.withColumns({"__place": F.pmod(F.xxhash64("__key", F.lit("place")), F.lit(PLACES)).cast("int"),
                           "__p": F.shiftrightunsigned(F.xxhash64(*own, F.lit("first")), 64 - BITS), "__q": F.xxhash64(*own, F.lit("second"))})


def _size(text: str = "text") -> Column:
    return F.octet_length(text_of(text)).cast("long") + 1


def units(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """One narrow row per row of ``docs``: key, hash, copy number and weight (1 by default), as a staged table.

    Equal rows are counted before they are exchanged and numbered afterwards, in blocks that go to many tasks."""
    own = docs.select(key_of().alias("__key"), hash_of_text().alias("__hash"), (F.lit(1) if weight is None else weight).cast("long").alias("__weight"))
    counted = own.groupBy("__key", "__hash", "__weight").agg(F.count("*").alias("__n"))
    blocks = counted.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / BLOCK))).alias("__block"))
    first = F.col("__block") * BLOCK
    blocks = blocks.repartition("__key", "__hash", "__block")
    rows = blocks.select("__key", "__hash", "__weight", "__n", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("__n")) - 1)).alias("__copy"))
    return stage(_ranked(rows).sortWithinPartitions("__p"), "shard-units")


def capacities(total: int, ring: Ring, slack: float = 0.0) -> list[int]:
    """Equal capacities that sum up to the total and its slack; without slack they are at most one apart."""
    whole = math.ceil(total * (1 + slack))
    return [(whole + ring.shards - 1 - s) // ring.shards for s in range(ring.shards)]


def lay_out(rows: DataFrame, ring: Ring, capacity: list[int]) -> Layout:
    """When each shard fills, from a staged table of units."""
    out = Layout(ring, capacity)
    full = {s for s in range(ring.shards) if capacity[s] <= 0}
    out.fills = [(-1, 0, s) for s in sorted(full)]
    loads, owner = [0] * ring.shards, ring.owners(full)

    def add(place: int, weight: int, p: int, q: int) -> None:
        nonlocal owner
        s = owner[place]
        loads[s] += weight
        if s not in full and loads[s] >= capacity[s]:
            full.add(s)
            out.fills.append((p, q, s))
            owner = ring.owners(full)

    def walk(part: DataFrame, low: int, bits: int) -> None:
        """All units of a prefix, whose priorities start at ``low`` and differ in the last ``bits`` bits."""
        step = min(STEP, bits)
        prefix = F.shiftright(F.col("__p") - F.lit(low), bits - step).cast("int")
        cells = part.groupBy(prefix.alias("prefix"), "__place").agg(F.sum("__weight").alias("weight"), F.count("*").alias("n")).toArrow().to_pydict()
        by = {}
        for k, place, weight, n in zip(cells["prefix"], cells["__place"], cells["weight"], cells["n"]):
            by.setdefault(k, []).append((place, weight, n))
        for k in sorted(by):
            more = [0] * ring.shards
            for place, weight, _ in by[k]:
                more[owner[place]] += weight
            if not any(s not in full and loads[s] + more[s] >= capacity[s] for s in range(ring.shards)):
                for s in range(ring.shards):
                    loads[s] += more[s]
                continue
            start = low + (k << (bits - step))
            inside = part.where((F.col("__p") >= start) & (F.col("__p") < start + (1 << (bits - step))))
            if sum(n for *_, n in by[k]) > READ and bits > step:
                walk(inside, start, bits - step)
                continue
            got = inside.select("__p", "__q", "__place", "__weight").toArrow().to_pydict()
            for p, q, place, weight in sorted(zip(got["__p"], got["__q"], got["__place"], got["__weight"])):
                add(place, weight, p, q)

    if len(full) < ring.shards:
        walk(rows, 0, BITS)
    return out


def placed(rows: DataFrame, layout: Layout) -> DataFrame:
    """Add __shard to rows with place and priorities; the table of the layout has a fixed size and is broadcast."""
    return rows.withColumn("__era", layout.era()).join(F.broadcast(layout.table(rows.sparkSession)), ["__era", "__place"])


def _numbered(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents with key, hash and copy number. Only rows that repeat doc_id and text are counted and staged."""
    marked = docs.withColumns({"__key": key_of(), "__hash": hash_of_text()})
    several = stage(rows.where("__copy = 0 and __n > 1").select("__key", "__hash"), "shard-repeats")
    if several.limit(1).count() == 0:
        return marked.withColumn("__copy", F.lit(0).cast("long"))
    on = ["__key", "__hash"]
    again = stage(marked.join(several, on, "left_semi").withColumn("__part", F.spark_partition_id()), "shard-repeated-rows")
    parts = again.groupBy(*on, "__part").agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy(*on).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(*on, "__part").orderBy(F.lit(0)))
    counted = again.withColumn("__row", within).join(parts.select(*on, "__part", before.alias("__before")), [*on, "__part"])
    counted = counted.withColumn("__copy", (F.col("__before") + F.col("__row") - 1).cast("long"))
    single = marked.join(several, on, "left_anti").withColumn("__copy", F.lit(0).cast("long"))
    return single.unionByName(counted.select(*single.columns))


def write_shards(docs: DataFrame, path: str, ring: Ring = Ring(), law: str = "rows", slack: float = 0.0) -> Layout:
    """Write ``docs`` as Parquet, one folder per shard, each row with its slot, sorted by slot within a file.

    ``law``: what a capacity bounds, ``rows`` or ``bytes`` (size of the text in UTF-8 plus 1). ``slack``: the share by which
    capacities exceed the mean; 0 makes counts at most one apart (bytes: each shard exceeds its share by less than one row)."""
    docs = docs.drop("shard", "slot")
    rows = units(docs, _size() if law == "bytes" else None)
    total, n = rows.agg(F.sum("__weight"), F.count("*")).first()
    layout = lay_out(rows, ring, capacities(total or 0, ring, slack))
    bits = min(40, max(0, math.ceil(math.log2(max(1, n / STRETCH / ring.shards)))))
    stretch = F.shiftright("__p", BITS - bits)
    counts = placed(rows, layout).groupBy("__shard", stretch.alias("__stretch")).agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy("__shard").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stage(counts.select("__shard", "__stretch", before.alias("__start")), "shard-starts")
    out = placed(_ranked(_numbered(docs, rows)), layout).withColumn("__stretch", stretch).join(starts, ["__shard", "__stretch"])
    within = F.row_number().over(Window.partitionBy("__shard", "__stretch").orderBy("__p", "__q"))
    out = out.withColumn("slot", (F.col("__start") + within - 1).cast("long"))
    out.select(*docs.columns, "slot", F.col("__shard").alias("shard")).write.partitionBy("shard").parquet(path)
    return layout


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """All rows of written shards; ``docs`` gives the schema."""
    from pyspark.sql.types import IntegerType, LongType
    schema = docs.drop("shard", "slot").schema.add("slot", LongType()).add("shard", IntegerType())
    return spark.read.schema(schema).parquet(path)


def shard_documents(docs: DataFrame, path: str, ring: Ring = Ring()) -> DataFrame:
    """Write shards under the law of equal row counts, read them back and digest each row."""
    write_shards(docs, path, ring)
    back = read_shards(docs.sparkSession, path, docs)
    return back.select("doc_id", _size().alias("size"), F.crc32(text_of()).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))
