"""Dates, numbers, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_seconds(ts: Column) -> Column:
    """UTC with seconds; the clock is an argument, so results repeat."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_date(seconds: Column) -> Column:
    """D02."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def stamp_year(ts: Column) -> Column:
    """2020 where fewer than four digits are given."""
    return F.coalesce(F.when(F.length(ts) >= 4, F.substring(ts, 1, 4).try_cast("int")), F.lit(2020))


def partial_date(c: Column) -> Column:
    """D04: 'day', 'month' or 'year' as a date is precise, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").when(c.rlike(r"^\d{4}-\d{2}$"), "month").when(c.rlike(r"^\d{4}$"), "year")


def sane_month_day(c: Column) -> Column:
    """Ranges only, so 30 February passes (compatible)."""
    return c.rlike(r"^\d{4}-\d\d-\d\d$") & F.substring(c, 6, 2).try_cast("int").between(1, 12) & F.substring(c, 9, 2).try_cast("int").between(1, 31)


def retry_after(c: Column, now: Column) -> Column:
    """Seconds, or a date as seconds from now; the past counts as 0, what is neither is null."""
    at = F.try_to_timestamp(F.regexp_replace(F.trim(c), r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(F.trim(c).try_cast("double"), (F.unix_timestamp(at) - F.unix_timestamp(now)).cast("double"))
    return F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait))


def decibel_gain(db: Column) -> Column:
    """M01."""
    return F.pow(F.lit(10.0), db / 20)


def pan_coefficients(position: Column, law_db: float = -3.0) -> tuple[Column, Column]:
    """Left and right; the centre has the law's gain, positions beyond the sides are clamped."""
    theta = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), position)) + 1) * F.pi() / 4
    scale = 10 ** (law_db / 20) * 2**0.5
    return F.cos(theta) * scale, F.sin(theta) * scale


def pre_attenuation(peak: Column) -> Column:
    """None below -3, one up to -1, else down to -3."""
    return F.when(peak < -3, 0.0).when(peak <= -1, -1.0).otherwise(-(peak + 3))


def residual_verdict(c: Column) -> Column:
    """M03."""
    return F.when(c.isNull(), "measurement_failed").when(c <= -90, "pass").when(c <= -60, "smell").otherwise("fail")


def mono_fold(delta: Column) -> Column:
    """M04."""
    return F.when(delta <= 3, "mono_compatible").when(delta <= 6, "mono_partial_cancellation").when(delta <= 12, "mono_phase_warning").otherwise("mono_phase_severe")


# Integrated loudness and true peak asked for.
LOUDNESS = {"Spotify": (-14.0, -1.0), "Apple Music": (-16.0, -1.0), "YouTube": (-14.0, -1.0), "Tidal": (-14.0, -1.0), "SoundCloud": (-14.0, -1.0), "Amazon Music": (-14.0, -2.0), "EBU R128": (-23.0, -1.0), "ATSC A/85": (-24.0, -2.0)}


def loudness_deltas(lufs: Column, peak: Column, platforms: tuple[str, ...] = ("Spotify", "Apple Music", "EBU R128")) -> Column:
    """One struct per known platform."""
    return F.array(*[F.struct(F.lit(p).alias("platform"), F.round(lufs - LOUDNESS[p][0], 2).alias("lufs_delta"), F.round(LOUDNESS[p][1] - peak, 2).alias("headroom_delta")) for p in platforms if p in LOUDNESS])


def rational(c: Column) -> Column:
    """M06: '60000/1001' as a number."""
    return F.try_divide(F.split_part(c, F.lit("/"), F.lit(1)).try_cast("double"), F.coalesce(F.nullif(F.split_part(c, F.lit("/"), F.lit(2)), F.lit("")).try_cast("double"), F.lit(1.0)))


def standard_rate(rate: Column) -> Column:
    """The nearest standard frame rate within half a percent, else null."""
    out = F.lit(None).cast("string")
    for name, r in reversed((("24000/1001", 24000 / 1001), ("24/1", 24.0), ("25/1", 25.0), ("30000/1001", 30000 / 1001), ("30/1", 30.0), ("50/1", 50.0), ("60000/1001", 60000 / 1001), ("60/1", 60.0))):
        out = F.when(F.abs(rate - r) < 0.0005 * r, name).otherwise(out)
    return out


def field_ratio(ratio: Column) -> Column:
    """Two fields a frame."""
    return ratio.between(1.7, 2.3)


def half_fraction(share: Column) -> Column:
    return share.between(0.35, 0.65)


def hex_channels(c: Column) -> Column:
    """M08: '#rrggbb' as three numbers."""
    h = F.regexp_replace(c, "^#", "")
    return F.array(*[F.conv(F.substring(h, i, 2), 16, 10).cast("int") for i in (1, 3, 5)])


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """M09, without jitter."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt))


def same_aspect(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """Within 5 % in whole numbers."""
    a, b = w1 * h2, w2 * h1
    return F.abs(a - b) * 100 <= F.greatest(a, b) * 5


def layered(*values: Column) -> Column:
    """The first that is given."""
    return F.coalesce(*values)


# Bit depth of a sample format.
DEPTHS = {"u8": 8, "s16": 16, "s16p": 16, "s32": 32, "s32p": 32, "flt": 32, "fltp": 32, "dbl": 64, "dblp": 64}


def bit_depth(valid_bits: Column, raw_bits: Column, sample_fmt: Column) -> Column:
    """M13."""
    m = F.create_map(*[F.lit(x) for kv in DEPTHS.items() for x in kv])
    return F.coalesce(F.nullif(valid_bits, F.lit(0)), F.nullif(raw_bits, F.lit(0)), F.try_element_at(m, sample_fmt))


def publish_date(urls: Column) -> Column:
    """The earliest '?v=' stamp of an address list."""
    stamps = F.transform(urls, lambda u: F.regexp_extract(u, r"\?v=(\d+)", 1).try_cast("long"))
    return epoch_date(F.array_min(F.filter(stamps, lambda s: s.isNotNull())))


def line_ranges(spec: Column) -> Column:
    """AR5: '9,10-12' as an array of (lo, hi)."""
    return F.transform(F.split(F.regexp_replace(spec, r"\s", ""), ","), lambda p: F.struct(F.substring_index(p, "-", 1).try_cast("int").alias("lo"), F.substring_index(p, "-", -1).try_cast("int").alias("hi")))


def ladder(current: Column, steps: tuple[int, ...] = (96, 128, 160, 192, 256, 320)) -> Column:
    """AR6: the larger steps."""
    return F.filter(F.array(*[F.lit(s) for s in steps]), lambda x: x > current)


def lower_keys(m: Column) -> Column:
    """MP2; of keys that fall together the last counts."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def merged_maps(*maps: Column) -> Column:
    """MP3: later maps win."""
    out = maps[0]
    for m in maps[1:]:
        keep = F.map_filter(out, lambda k, _: ~F.map_contains_key(m, k))
        out = F.map_concat(keep, m)
    return out


def canonical_json(**fields: Column) -> Column:
    """JS2: keys sorted."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def graph_nodes(edges: Column) -> Column:
    """S22/JS3: the nodes of a connection."""
    return F.transform(edges, lambda e: e["node"])
