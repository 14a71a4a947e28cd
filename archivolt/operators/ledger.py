"""Keyed merges, work queues and audits of a crawl ledger; parquet has no MERGE, so each is a full join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRIABLE = ("throttle", "network", "http_5xx")
# Audit bucket and the stage that shrinks it, in order of preference.
BUCKETS = (("unenumerated_hosts", "cdx_dump"), ("unresolved_slugs", "fetch"), ("retry_queue_depth", "fetch"), ("index_missing", "download"))


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in order; an aggregation, so maps combine it."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("b"))
    return g.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], prefer_old: tuple[str, ...] = (), overwrite: tuple[str, ...] = ()) -> DataFrame:
    """New values win unless null; those of prefer_old only fill gaps; those of overwrite win even if null.

    new must hold one row per key (see last_per_key); null keys never match, as in a table with a primary key.
    """
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns], F.lit(True).alias("_new"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_n_{k}"))
    j = old.withColumn("_old", F.lit(True)).join(n, cond, "full_outer")
    out = [F.coalesce(F.col(k), F.col(f"_n_{k}")).alias(k) for k in keys]
    for c in old.columns:
        if c in keys:
            continue
        if f"_n_{c}" not in n.columns:
            out.append(F.col(c))
        elif c in overwrite:
            out.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            a, b = (F.col(c), F.col(f"_n_{c}")) if c in prefer_old else (F.col(f"_n_{c}"), F.col(c))
            out.append(F.coalesce(a, b).alias(c))
    return j.select(*out)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new keys only, the batch's own repeats dropped too."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"), allowMissingColumns=True)


def update(old: DataFrame, marks: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sets a column by key; keys that are missing change nothing."""
    m = marks.groupBy(*keys).agg(F.max(column).alias("_mark"))
    return old.join(m, keys, "left").withColumn(column, F.coalesce("_mark", column)).select(*old.columns)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """V07."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def latest(attempts: DataFrame, key: str = "url", at: str = "attempted_at") -> DataFrame:
    """The latest attempt of each address, by window; two of one second tie by the class's name."""
    w = Window.partitionBy(key).orderBy(F.desc(at), "failure_class")
    return attempts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def retry_queue(attempts: DataFrame) -> DataFrame:
    """Addresses whose latest attempt failed in a way that may pass."""
    return latest(attempts).filter(F.col("failure_class").isin(*RETRIABLE))


def audit(entities: DataFrame, hosts: DataFrame, surfaces: DataFrame, attempts: DataFrame) -> DataFrame:
    """The residual counts in one row, and the status."""
    one = entities.agg(F.count_if(F.col("resolved_at").isNull()).alias("unresolved_slugs"))
    one = one.crossJoin(hosts.agg(F.count_if(F.col("cdx_dumped_at").isNull()).alias("unenumerated_hosts")))  # one row each
    one = one.crossJoin(surfaces.agg(F.count_if(F.col("parsed_at").isNull()).alias("unexpanded_surfaces"))).crossJoin(retry_queue(attempts).agg(F.count("*").alias("retry_queue_depth")))
    total = F.col("unresolved_slugs") + F.col("unenumerated_hosts") + F.col("unexpanded_surfaces") + F.col("retry_queue_depth")
    return one.withColumn("residual", total).withColumn("status", F.when(total == 0, "complete").otherwise("open"))


def next_stage(counts: DataFrame) -> DataFrame:
    """(bucket, value, stage) of the largest bucket above zero; order of preference breaks ties."""
    items = F.array(*[F.struct(F.coalesce(F.col(b), F.lit(0)).alias("value"), F.lit(-i).alias("rank"), F.lit(b).alias("bucket"), F.lit(s).alias("stage")) for i, (b, s) in enumerate(BUCKETS) if b in counts.columns])
    return counts.select(F.array_max(items).alias("b")).filter("b.value > 0").select("b.bucket", "b.value", "b.stage")


def breaker(attempts: DataFrame, key: str, order: list[str], ok: str) -> DataFrame:
    """T05 as a batch: consecutive failures so far, the pause they bring and whether the domain is skipped."""
    w = Window.partitionBy(key).orderBy(*order)
    run = F.sum(F.col(ok).cast("int")).over(w)
    out = attempts.withColumn("_run", run)
    upto = Window.partitionBy(key, "_run").orderBy(*order)
    n = F.sum((~F.col(ok)).cast("int")).over(upto)
    out = out.withColumn("failures", n).withColumn("pause_s", F.when(F.col(ok), 0).when(n == 3, 120).when(n == 6, 300).otherwise(0))
    return out.withColumn("tripped", F.max(F.when(F.col("failures") >= 10, 1).otherwise(0)).over(w) == 1).drop("_run")


def healthiest(attempts: DataFrame, key: str, ok: str) -> DataFrame:
    """Keys in the order to try them: such as ever answered first, then the lowest failure rate, then the name."""
    g = attempts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg((~F.col(ok)).cast("double")).alias("rate"), F.max(ok).alias("closed"))
    return g.orderBy(F.desc("closed"), "rate", key)


def first_known(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value): the first value that is given; later ones never replace it. An aggregation that maps combine."""
    return df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def error_rate(attempts: DataFrame, key: str, seconds: str, ok: str, window: int = 300, least: int = 10, most: int = 300, tie: str | None = None) -> DataFrame:
    """Samples and failure rate of the outcomes up to each, at most the last `most` and none older than `window` seconds; null below `least`.

    The frame is bounded by rows, so an attempt looks at `most` others, however many a second holds; `tie`
    orders those of one second.
    """
    w = Window.partitionBy(key).orderBy(seconds, *([tie] if tie else [])).rowsBetween(1 - most, 0)
    recent = F.filter(F.collect_list(F.struct(F.col(seconds).alias("s"), F.col(ok).alias("ok"))).over(w), lambda x: x["s"] >= F.col(seconds) - window)
    out = attempts.withColumn("_o", recent).withColumn("samples", F.size("_o"))
    return out.withColumn("rate", F.when(F.col("samples") >= least, F.size(F.filter("_o", lambda x: ~x["ok"])) / F.col("samples"))).drop("_o")
