"""Ordered series: gaps, islands, as-of lookups, lookahead frames. Every window is partitioned by the series' key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRAP = -4294967296


def delta_classes(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Wrap, backward, duplicate or forward against the row before; nulls are skipped, first rows have none."""
    w = Window.partitionBy(key).orderBy(order)
    d = F.col(value) - F.lag(value).over(w)
    return df.filter(F.col(value).isNotNull()).withColumn("delta", d).withColumn("kind", F.when(d < WRAP, "wrap").when(d < 0, "backward").when(d == 0, "duplicate").when(d > 0, "forward"))


def adjacent_flags(df: DataFrame, key: str, order: str, value: str, first: int = 5000) -> DataFrame:
    """As W03 over the first rows only, where a null breaks adjacency."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= first).withColumn("delta", F.col(value) - F.lag(value).over(w)).drop("_n")


def gaps(df: DataFrame, key: str, order: str, value: str, frame: Column | None = None, times: float = 1.5) -> DataFrame:
    """Per key the number of gaps beyond times x frame, what is missing and where the first begins; without a frame the mean delta counts."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.filter(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_at", F.lag(value).over(w))
    mean = F.avg("_d").over(Window.partitionBy(key))
    d = d.withColumn("_f", F.coalesce(F.nullif(frame, F.lit(0)) if frame is not None else F.lit(None).cast("double"), mean))
    wide = F.col("_d") > times * F.col("_f")
    return d.groupBy(key).agg(F.count_if(wide).alias("n_gaps"), F.coalesce(F.sum(F.when(wide, F.col("_d") - F.col("_f"))), F.lit(0.0)).alias("missing"), F.min(F.when(wide, F.col("_at"))).alias("first_gap"))


def max_gap(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """W05."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_d", F.col(value) - F.lag(value).over(w)).groupBy(key).agg(F.max("_d").alias("max_gap"))


def rows_before(df: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """Rows before the first flagged one; all of them without one."""
    w = Window.partitionBy(key).orderBy(order)
    n = df.withColumn("_n", F.row_number().over(w)).withColumn("_f", flag)
    return n.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("_f"), F.col("_n"))) - 1, F.count("*")).alias("before"))


def longest_run(df: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """The longest island of flagged rows."""
    w, f = Window.partitionBy(key).orderBy(order), Window.partitionBy(key, "_f").orderBy(order)
    n = df.withColumn("_f", flag).withColumn("_i", F.row_number().over(w) - F.row_number().over(f))
    return n.groupBy(key, "_i", "_f").agg(F.count("*").alias("_n")).groupBy(key).agg(F.coalesce(F.max(F.when(F.col("_f"), F.col("_n"))), F.lit(0)).alias("longest"))


def ramp_excursion(df: DataFrame, key: str, order: str, value: str, step: float) -> DataFrame:
    """The range of the deviation from first + i x step."""
    w = Window.partitionBy(key).orderBy(order)
    dev = F.col(value) - (F.first(value).over(w) + (F.row_number().over(w) - 1) * step)
    return df.withColumn("_d", dev).groupBy(key).agg(F.round(F.max("_d") - F.min("_d"), 6).alias("excursion"))


def open_frames(df: DataFrame, key: str, order: str, value: str, flag: Column, other: Column, ahead: int = 6) -> DataFrame:
    """A flagged row is open if one of the next rows of the other kind has a smaller value than its own."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1, ahead)
    nxt = F.collect_list(F.struct(F.col(value).alias("v"), other.alias("o"))).over(w)
    rows = df.withColumn("_next", nxt).withColumn("open", F.exists("_next", lambda r: r["o"] & (r["v"] < F.col(value))))
    return rows.filter(flag).drop("_next")


def reorder_scan(df: DataFrame, key: str, order: str, pts: str, dts: str) -> DataFrame:
    """W10."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_b", F.col(pts) < F.lag(pts).over(w)).groupBy(key).agg(F.count_if("_b").alias("backward"), F.count_if(F.col(pts) != F.col(dts)).alias("differ"), F.max(F.abs(F.col(pts) - F.col(dts))).alias("max_offset"))


def evenly(df: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """About n rows at even distances with the midpoint to the row after."""
    w = Window.partitionBy(key).orderBy(order)
    count = F.count("*").over(Window.partitionBy(key))
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_m", (F.col(value) + F.lead(value).over(w)) / 2).withColumn("_step", F.greatest(F.floor(count / n), F.lit(1)))
    return rows.filter((F.col("_i") % F.col("_step") == 0) & (F.floor(F.col("_i") / F.col("_step")) < n)).withColumnRenamed("_m", "midpoint").drop("_i", "_step")


def spans(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Spans of two clocks, their skew, rate and nulls."""
    span = lambda c: F.max(c) - F.min(c)
    return df.groupBy(key).agg(span(a).alias("span_a"), span(b).alias("span_b"), (span(a) - span(b)).alias("skew"), F.try_divide(F.count(a) - 1, span(a)).alias("rate"), F.count_if(F.col(a).isNull()).alias("missing"))


def around_peak(df: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """The row of the highest score (the first of equals) with the scores beside it."""
    w = Window.partitionBy(key).orderBy(order)
    n = df.withColumn("before", F.lag(score).over(w)).withColumn("after", F.lead(score).over(w))
    g = n.groupBy(key).agg(F.max(F.struct(F.col(score).alias("score"), (-F.col(order)).alias("_o"), F.col("before"), F.col("after"))).alias("b"))
    return g.select(key, (-F.col("b._o")).alias(order), F.col("b.score").alias("score"), F.col("b.before").alias("before"), F.col("b.after").alias("after"))


def blocks(df: DataFrame, key: str, order: str, header: Column) -> DataFrame:
    """The number of the block a row belongs to, counted by header rows."""
    return df.withColumn("block", F.sum(header.cast("int")).over(Window.partitionBy(key).orderBy(order)))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, forward: bool = False) -> DataFrame:
    """Per left row the last right row at or before its time (forward: the first at or after), by key.

    One pass over the union of both sides in a window by key; no pair is ever built.
    """
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[at].dataType).alias("_t"), F.lit(1).alias("_side"))
    b = right.select(key, at, F.col(value).alias("_v"), F.col(at).alias("_t"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    if forward:
        w = Window.partitionBy(key).orderBy(F.col(at).desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(key).orderBy(F.col(at), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("matched", F.last("_v", True).over(w)).withColumn("matched_at", F.last("_t", True).over(w))
    return out.filter("_side = 1").drop("_v", "_t", "_side")


def range_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points in closed intervals, by buckets of the given width: an equi-join, then the exact test."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    i = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(i, "_b").filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_b")


def band_pairs(df: DataFrame, key: str, value: str, most: float) -> DataFrame:
    """Pairs of neighbours at most so far apart: each row with the rows after it, by buckets of that width."""
    a = df.select(F.col(key).alias("a"), F.col(value).alias("va")).withColumn("_b", F.explode(F.array(F.floor(F.col("va") / most), F.floor(F.col("va") / most) + 1)))
    b = df.select(F.col(key).alias("b"), F.col(value).alias("vb")).withColumn("_b", F.floor(F.col("vb") / most))
    c = df.select(F.col(key).alias("b"), F.col(value).alias("vb")).withColumn("_b", F.floor(F.col("vb") / most) + 1)
    near = (F.abs(F.col("va") - F.col("vb")) <= most) & (F.col("a") < F.col("b"))
    return a.join(b.unionByName(c), "_b").filter(near).select("a", "b").distinct()


def index_percentile(df: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles by truncated index, without gathering a group: rank and count come from windows."""
    w = Window.partitionBy(key).orderBy(value)
    r = df.filter(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return r.groupBy(key).agg(*[F.max(F.when(F.col("_i") == F.least(F.floor(F.col("_n") * p), F.col("_n") - 1), F.col(value))).alias(f"p{int(p * 100)}") for p in shares])


def histogram(df: DataFrame, value: Column, keys: list[str] | None = None, top: int = 3) -> DataFrame:
    """The most frequent values with their counts; smaller values first at equal counts."""
    keys = keys or []
    c = df.groupBy(*keys, value.alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "value") if keys else Window.orderBy(F.desc("n"), "value")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def apply_each(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for s in steps:
        df = s(df)
    return df
