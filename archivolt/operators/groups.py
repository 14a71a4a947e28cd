"""Rules over groups of measured stems: format, pan, layouts, coded flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def output_format(stems: DataFrame, group: str) -> DataFrame:
    """Rate, depth and dither of a group's mix. Anything lossy caps it at 44100/16; depth is at most 24."""
    g = stems.groupBy(group).agg(F.bool_or("is_lossy").alias("lossy"), F.max(F.nullif("sample_rate", F.lit(0))).alias("rate"), F.min(F.when(~F.col("is_lossy"), F.nullif("bit_depth", F.lit(0)))).alias("depth"))
    rate = F.when(F.col("lossy"), 44100).otherwise(F.coalesce("rate", F.lit(44100)))
    depth = F.when(F.col("lossy"), 16).otherwise(F.least(F.coalesce("depth", F.lit(16)), F.lit(24)))
    return g.select(group, "lossy", rate.alias("rate"), depth.alias("depth")).withColumn("dither_required", F.col("depth") <= 16)


def auto_pan(stems: DataFrame, group: str, order: str) -> DataFrame:
    """Mono stems but voices and bass spread evenly, at most 0.7 wide; two stand at half."""
    spread = (F.col("channels") == 1) & ~F.col("classification").isin("vocal", "bass")
    w = Window.partitionBy(group, "_s")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    pos = F.when(n == 1, 0.0).when(n == 2, F.when(i == 0, -0.5).otherwise(0.5)).otherwise((2 * i / (n - 1) - 1) * 0.7)
    return stems.withColumn("_s", spread).withColumn("pan", F.when(F.col("_s"), pos).when(F.col("channels") == 1, 0.0)).drop("_s")


# Rank of an audio codec.
CODEC_RANK = (("^pcm_|^(flac|alac|truehd|mlp)$", 3), ("^(eac3|ac3|aac|opus|vorbis|dts|dca)$", 2), ("^mp[123]$", 1))


def codec_rank(codec: Column) -> Column:
    out = F.lit(0)
    for p, r in reversed(CODEC_RANK):
        out = F.when(F.lower(codec).rlike(p), r).otherwise(out)
    return out


def keep_best_layout(tracks: DataFrame, group: str) -> DataFrame:
    """Per layout the best codec and then the earliest track is kept; the others are dropped with the reason."""
    w = Window.partitionBy(group, "layout").orderBy(F.desc("rank"), "ordinal")
    t = tracks.withColumn("rank", codec_rank(F.col("codec"))).withColumn("_n", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(group, "layout")))
    return t.withColumn("verdict", F.when(F.col("_n") == 1, "KEEP").otherwise("DROP")).withColumn("reason", F.when(F.col("n") == 1, "only one of its layout").when(F.col("_n") == 1, "best of its layout").otherwise("a better or earlier track has its layout")).drop("_n")


def stem_flags(stems: DataFrame, group: str) -> DataFrame:
    """(group, severity, code, affected) of stems; per file and per group, as of a fixed rule list."""
    def flag(cond: Column, severity: str, code: str) -> Column:
        return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))

    longest = F.max("duration_samples").over(Window.partitionBy(group))
    per_file = F.array_compact(F.array(
        flag(F.col("true_peak_dbtp") > 0, "warn", "input_clipping"), flag(F.col("dc_offset_max") > 0.001, "warn", "dc_offset"), flag(F.col("fully_silent"), "warn", "silent_file"),
        flag(~F.col("fully_silent") & (F.col("channels") == 2) & (F.size("silent_channels") == 1), "warn", "dead_channel"), flag(F.col("channels") > 2, "error", "multichannel_input"), flag(F.col("is_lossy"), "warn", "lossy_input"),
        flag((F.col("duration_samples") > 0) & (F.col("_longest") - F.col("duration_samples") > 1), "warn", "length_drift"),
        flag((F.col("bit_depth_source") == "ffprobe_sample_fmt") & F.col("sample_fmt").isin("s32", "s32p") & F.col("filename").rlike(r"(?i)\.(wav|wave|rf64)$") & ~F.col("is_lossy"), "warn", "bit_depth_uncertain"),
    ))
    f = stems.withColumn("_longest", longest).select(group, "filename", F.explode(per_file).alias("x")).groupBy(group, "x.severity", "x.code").agg(F.array_sort(F.collect_list("filename")).alias("affected"))
    g = stems.groupBy(group).agg(
        F.countDistinct(F.nullif("sample_rate", F.lit(0))).alias("rates"), F.countDistinct(F.when(~F.col("is_lossy"), F.nullif("bit_depth", F.lit(0)))).alias("depths"), (F.max("time_reference") - F.min("time_reference")).alias("spread"), F.count_if(F.col("channels") == 1).alias("mono"), F.count_if((F.col("channels") == 1) & F.col("pan").isNull()).alias("centred"),
        F.array_sort(F.collect_list("filename")).alias("all"), F.array_sort(F.collect_list(F.when(~F.col("is_lossy"), F.col("filename")))).alias("lossless"), F.array_sort(F.collect_list(F.when(F.col("time_reference").isNotNull(), F.col("filename")))).alias("timed"), F.array_sort(F.collect_list(F.when(F.col("channels") == 1, F.col("filename")))).alias("monos"),
    )
    def group_flag(cond: Column, severity: str, code: str, affected: str) -> Column:
        return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(affected).alias("affected")))

    flags = F.array_compact(F.array(group_flag(F.col("rates") > 1, "error", "rate_mismatch", "all"), group_flag(F.col("depths") > 1, "warn", "depth_mismatch", "lossless"), group_flag(F.col("spread") > 1, "warn", "stems_unanchored", "timed"), group_flag(F.col("mono") > 0, "warn", "pan_law_default_assumed", "monos"), group_flag(F.col("centred") >= 3, "warn", "mono_pile_at_center", "monos")))
    return f.unionByName(g.select(group, F.explode(flags).alias("x")).select(group, "x.severity", "x.code", "x.affected"))


def master_flags(masters: DataFrame, stems: DataFrame, group: str) -> DataFrame:
    """(group, severity, code) of released masters against what their group's mix will be."""
    target = output_format(stems, group).join(stems.groupBy(group).agg(F.max("duration_samples").alias("longest")), group)
    m = masters.join(target.withColumnRenamed("lossy", "any_lossy"), group)
    def flag(cond: Column, severity: str, code: str) -> Column:
        return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))

    have = ~F.coalesce("missing", F.lit(False))
    flags = F.array_compact(F.array(flag(~have, "error", "master_missing"), flag(have & (F.col("sample_rate") != F.col("rate")), "error", "master_rate_mismatch"), flag(have & ~F.col("is_lossy") & (F.col("bit_depth") != F.col("depth")), "error", "master_depth_mismatch"), flag(have & (F.col("channels") != 2), "error", "master_channels_mismatch"), flag(have & (F.col("channels") > 2), "error", "master_multichannel"), flag(have & (F.abs(F.col("duration_samples") - F.col("longest")) > F.coalesce("tolerance", F.lit(1))), "error", "master_duration_mismatch"), flag(have & F.col("is_lossy") & ~F.col("any_lossy"), "warn", "master_lossy_with_lossless_stems")))
    return m.select(group, F.explode(flags).alias("x")).select(group, "x.severity", "x.code")


def missing_members(groups: DataFrame, group: str, members: str, stems: DataFrame, name: str) -> DataFrame:
    """(group, member) that no stem has; anything here is fatal."""
    return groups.select(group, F.explode(members).alias("member")).join(stems.select(F.col(name).alias("member")).distinct(), "member", "left_anti").select(group, "member")


def track_files(tracks: DataFrame, on_disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(track, file) of clips on disk, and the clips that are not."""
    t = tracks.select("track", F.explode("clips").alias("file")).distinct()
    return t.join(on_disk, "file", "left_semi").select("track", "file"), t.join(on_disk, "file", "left_anti").select("track", "file")


def escaped(findings: DataFrame, escapes: DataFrame, today: str) -> DataFrame:
    """J26 of lint findings: 'suppressed', 'expired' or null by registered exceptions; a valid one beats an expired one.

    Findings meet exceptions of their rule in an equi-join; file pattern and line ranges are tested after it.
    """
    glob = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("target", r"([.+(){}\[\]^$|\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    lines = F.transform(F.split(F.regexp_replace("lines", r"\s", ""), ","), lambda p: F.struct(F.substring_index(p, "-", 1).try_cast("int").alias("lo"), F.substring_index(p, "-", -1).try_cast("int").alias("hi")))
    whole = F.coalesce("lines", F.lit("")).isin("", "-", "any", "ANY", "*")
    e = escapes.select("esc_id", "axiom", glob.alias("glob"), whole.alias("whole"), lines.alias("ranges"), "expires")
    f = findings.withColumn("_id", F.monotonically_increasing_id())
    hit = f.join(e, "axiom").filter(F.rlike(F.regexp_replace("file", r"^\./", ""), F.col("glob")) & (F.col("whole") | F.exists("ranges", lambda r: (F.col("line") >= r["lo"]) & (F.col("line") <= r["hi"]))))
    best = hit.withColumn("status", F.when(F.lit(today) > F.col("expires"), "expired").otherwise("suppressed")).groupBy("_id").agg(F.max(F.struct("status", "esc_id")).alias("b"))
    return f.join(best, "_id", "left").select(*findings.columns, F.col("b.status").alias("status"), F.col("b.esc_id").alias("esc_id"))
