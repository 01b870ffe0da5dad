"""Range joins as bucketed equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, low: int, high: int
              ) -> DataFrame:
    """All pairs with equal keys and right_pos - left_pos in [low, high].

    The position axis is cut into buckets as wide as the band. A right row lies in one bucket and a left
    row is sent to the (at most two) buckets its band touches, so every pair meets exactly once and the
    join is a plain equi-join that AQE can split when a key is hot. Other column names must not clash.
    """
    width = max(1, high - low)
    bucket = lambda c: F.floor(c / F.lit(width))
    r = right.withColumn("_bucket", bucket(F.col(right_pos)))
    spread = F.sequence(bucket(F.col(left_pos) + low), bucket(F.col(left_pos) + high))
    l = left.withColumn("_bucket", F.explode(spread))
    joined = l.join(r, [*keys, "_bucket"]).drop("_bucket")
    gap = F.col(right_pos) - F.col(left_pos)
    return joined.where((gap >= low) & (gap <= high))
