"""Addresses of image renditions rewritten to their masters.

Each resolver is a pure (condition, rewrite) pair of Column expressions; the dispatcher takes the first that
gives a result, in order. Resolvers whose second half asks a network are given by their rewrite alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivolt.functions.urls import append_param, percent_decoded, strip_params

Resolver = tuple[str, Callable[[Column], Column], Callable[[Column], Column]]
IMG = r"\.(?:jpe?g|png|webp|gif|tiff?|avif)"


def bare(u: Column) -> Column:
    return F.substring_index(u, "?", 1)


def needle(pattern: str) -> str:
    """The longest text that every match of a pattern without top-level alternatives holds; '' if none is known."""
    if re.sub(r"\((?:[^()]|\([^()]*\))*\)", "", pattern).count("|"):
        return ""
    flat = re.sub(r"\\[dwsDWS]|\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\]", "\x00", pattern)
    runs, at = [""], 0
    while at < len(flat):
        c = flat[at]
        literal = flat[at + 1] if c == "\\" else c if c not in "\x00.^$*+?{}" else ""
        step = 2 if c == "\\" else 1
        if literal and flat[at + step : at + step + 1] in ("?", "*", "{"):
            literal = ""
        runs = [*runs[:-1], runs[-1] + literal] if literal else [*runs, ""]
        at += step
    return max(runs, key=len)


def has(pattern: str) -> Callable[[Column], Column]:
    """Tests a pattern, and first the cheap part of it."""
    n = needle(pattern)
    return lambda u: (u.contains(n) & u.rlike(pattern)) if len(n) > 3 else u.rlike(pattern)


def sub(pattern: str, by: str, keep_query: bool = True) -> Callable[[Column], Column]:
    return lambda u: F.regexp_replace(u if keep_query else bare(u), pattern, by)


def _embedded(u: Column) -> Column:
    v = percent_decoded(F.regexp_extract(u, r"[?&]url=([^&]+)", 1))
    origin = F.regexp_extract(u, r"^(https?://[^/]+)", 1)
    return F.when(v.startswith("/"), F.concat(origin, v)).otherwise(v)


def _with_query(query: str) -> Callable[[Column], Column]:
    return lambda u: F.concat(bare(u), F.lit("?" + query))


# Names of transforms that may lead the path of an uploaded image.
TRANSFORMS = "w|h|c|f|q|g|e|l|o|r|t|x|y|z|ar|bo|co|dl|dn|du|dpr|fl|fn|if|ki|pg|sp|so|vc"


def _cloudinary(u: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"/image/upload/([^?]*)", 1), "/+", "/"), "^/|/$", "")
    kept = F.regexp_replace(rest, rf"^(?:(?:[^/]*,[^/]*|s--[^/]*|(?:{TRANSFORMS})_[^/]*)/)+", "")
    out = F.concat(F.regexp_extract(u, r"^(.*?/image/upload/)", 1), kept, F.when(F.lower(kept).rlike(r"\.(jpg|jpeg|png|tif|tiff|webp|gif|avif|heic)$"), F.lit("")).otherwise(F.lit(".png")))
    return F.concat(out, F.when(u.contains("?"), F.concat(F.lit("?"), F.substring(u, F.instr(u, "?") + 1, F.lit(1 << 30)))).otherwise(F.lit("")))


def _mzstatic(u: Column) -> Column:
    thumb = F.regexp_extract(u, r"/image/thumb/(.+)/\d+x\d+[a-z]*(?:-\d+)?\.\w+", 1)
    origin = F.regexp_extract(bare(u), r"^https?://a\d+\.mzstatic\.com/[a-z]{2}/r\d+/\d+/(.+)$", 1)
    return F.concat(F.lit("https://is1-ssl.mzstatic.com/image/thumb/"), F.when(thumb != "", thumb).otherwise(origin), F.lit("/10000x10000.png"))


def _squarespace(u: Column) -> Column:
    return append_param(strip_params(u, ("format", "content-type")), "format", "original")


def _goat(u: Column) -> Column:
    c = F.replace(bare(u), F.lit("/transform/v1/"), F.lit("/"))
    slot = r"^(https?://image\.goat\.com)/(?:[a-z0-9-]+/)?(?:[0-9]+/)?(attachments/.*)$"
    return F.when(c.rlike(slot), F.regexp_replace(F.regexp_replace(c, slot, "$1/$2"), r"/(?:grid|medium|large)/([^/]+)$", "/original/$1"))


def _hypbst(u: Column) -> Column:
    inner = percent_decoded(F.regexp_extract(u, r"image-cdn\.hypb\.st/(https?%3A%2F%2F[^?]+)", 1))
    return F.when(inner.rlike(r"^http.*s3\.store\.hypebeast\.com/media/image/"), inner).otherwise(_with_query("q=100&w=9999")(u))


def _reddit(u: Column) -> Column:
    slugged = F.regexp_extract(u, r"preview\.redd\.it/[^/?]*-v0-([a-z0-9]{8,24})\.(?:jpe?g|png|gif|webp)", 1)
    plain = F.regexp_extract(u, r"preview\.redd\.it/([a-z0-9]{8,24})\.(?:jpe?g|png|gif|webp)", 1)
    key = F.coalesce(F.nullif(slugged, F.lit("")), F.nullif(plain, F.lit("")))
    return F.concat(F.lit("https://i.redd.it/"), key, F.lit("."), F.regexp_extract(u, r"\.(jpe?g|png|gif|webp)(?:\?|$)", 1))


def _shop(u: Column) -> Column:
    v = F.regexp_extract(u, r"[?&](v=[^&]+)", 1)
    name = F.regexp_replace(F.regexp_replace(bare(u), r"_(?:pico|icon|thumb|small|compact|medium|large|grande)(\.[A-Za-z0-9]+)$", "$1"), r"_\d+x\d+(\.[A-Za-z0-9]+)$", "$1")
    return F.concat(name, F.lit("?"), F.when(v != "", F.concat(v, F.lit("&"))).otherwise(F.lit("")), F.lit("format=png"))


def _no_op(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda u: F.when(f(u) != u, f(u))


# Triggers and rewrites, in the order of dispatch.
RESOLVERS: tuple[Resolver, ...] = (
    ("r01", has(r"/_next/image\?"), _embedded),
    ("r02", has(r"/\.netlify/images\?"), _embedded),
    ("r03", has(r"substackcdn\.com/image/fetch/"), lambda u: percent_decoded(F.regexp_extract(u, r"/image/fetch/.*?(https?(?:%3A|:)[^?]*)", 1))),
    ("r04", has(r"playboy\.com/wp-content/uploads/(?:[^?]*/)?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}_\d+x\d+[^/]*$"), lambda u: F.concat(F.lit("https://substack-post-media.s3.amazonaws.com/public/images/"), F.regexp_extract(bare(u), r"/([0-9a-f]{8}-[0-9a-f-]{27}_\d+x\d+)[^/]*$", 1), F.lit(".jpeg"))),
    ("r05", has(r"//i[0-9]\.wp\.com/"), sub(r"^https?://i[0-9]\.wp\.com/", "https://", False)),
    ("r06", has(rf"//(?:www\.)?(?:rollingstone|variety|billboard|wwd|deadline|hollywoodreporter)\.com/wp-content/uploads/.*{IMG}\?"), bare),
    ("r07", has(rf"/wp-content/uploads/.*{IMG}"), _no_op(sub(rf"(?:-scaled|-e\d{{10,}}|-\d+x\d+)+({IMG})$", "$1", False))),
    ("r08", has(r"/cdn-cgi/image/"), sub(r"/cdn-cgi/image/[^/]+/", "/")),
    ("r09", has(r"/unsafe/.*https?(?::|%3A)"), lambda u: percent_decoded(F.regexp_extract(u, r"/unsafe/.*?(https?(?::|%3A).*)$", 1))),
    ("r11", has(r"images\.wsj\.net/im-"), lambda u: append_param(bare(u), "width", "10000")),
    ("r12", has(r"//media\.[^/]*\.com/photos/"), sub(r"(/photos/[^/]+)/[^/]+/[^/]+/", "$1/master/pass/")),
    ("r13", has(r"//lh\d*\.googleusercontent\.com/"), lambda u: F.concat(F.substring_index(u, "=", 1), F.lit("=s0"))),
    ("r14", has(r"pbs\.twimg\.com"), lambda u: F.when(u.contains("name="), F.regexp_replace(u, "name=[^&]*", "name=orig")).otherwise(append_param(u, "name", "orig"))),
    ("r15", has(r"//i\.pinimg\.com/"), sub(r"/\d+x\d*/", "/originals/")),
    ("r16", has(r"//preview\.redd\.it/[^/]+$"), _reddit),
    ("r18", has(r"//s\.hdnux\.com/photos/"), _no_op(sub(r"/[^/]+$", "/rawImage.jpg", False))),
    ("r19", has(r"cache\.(?:mrporter|net-a-porter)\.com/(?:.*variants/images/|images/products/[^/]+/[^/]+_(?:tn|sm|md|lg|xl|xxl|\d+)\.(?:jpg|jpeg|webp|png)(?:\?|$))"), lambda u: F.when(u.contains("/variants/images/"), F.regexp_replace(u, r"/w\d+_q\d+\.", "/w2000_q60.")).otherwise(F.regexp_replace(u, r"_(?:tn|sm|md|lg|xl|xxl|\d+)\.(jpg|jpeg|webp|png)", "_2000.$1"))),
    ("r20", has(r"/image/upload/"), _no_op(_cloudinary)),
    ("r21", has(r"ucarecdn\.com.*/-/"), lambda u: F.substring_index(u, "/-/", 1)),
    ("r22", has(r"storyblok\.com/"), _no_op(sub(r"/m/.*$", ""))),
    ("r23", has(r"media\.tumblr\.com/"), _no_op(sub(r"/s\d+x\d+[^/]*/", "/"))),
    ("r24", has(r"//(?:freight\.cargo\.site|cortex\.persona\.co)/.*/i/"), sub(r"^(https?://[^/]+)/.*?(/i/.*)$", "$1/t/original$2")),
    ("r25", has(r"//i\.imgur\.com/"), _no_op(sub(r"[sbtmlh](\.\w+)$", "$1", False))),
    ("r27", has(r"cargocollective\.com/"), _no_op(sub(r"_\d{3,4}(?:_c)?(\.[a-z]+)$", "$1"))),
    ("r31", has(r"skims(?:-sanity)?\.imgix\.net/.*\?"), bare),
    ("r29", has(r"\.imgix\.net/.*\?"), bare),
    ("r30", has(r"//imgix\.bustle\.com/"), _with_query("q=100")),
    ("r32", has(r"//(?:images\.stockx\.com|stockx\.imgix\.net)/"), lambda u: F.regexp_replace(bare(u), r"^https?://[^/]+", "https://stockx.imgix.net")),
    ("r33", has(r"//cdn\.sanity\.io/.*\?"), bare),
    ("r34", has(r"//images\.ctfassets\.net/.*\?"), bare),
    ("r35", has(r"cdn\.shopify\.com/s/files/\d+/|/cdn/shop/(?:products|files)/"), _no_op(_shop)),
    ("r36", has(r"im(?:width)?="), _no_op(lambda u: strip_params(u, ("im", "imwidth", "imheight", "imbypass", "imformat", "imquality", "impolicy")))),
    ("r37", lambda u: sum((u.contains(k + "=").cast("int") for k in ("width", "height", "format", "quality", "fit")), F.lit(0)) >= 2, _no_op(lambda u: strip_params(u, ("width", "height", "format", "quality", "fit", "crop")))),
    ("r38", has(r"\.b-cdn\.net/.*\?"), bare),
    ("r39", has(r"\.sirv\.com/.*\?"), bare),
    ("r40", has(r"//image-cdn\.hypb\.st/"), _hypbst),
    ("r41", has(r"/resizer/.*[?&]auth="), lambda u: append_param(u, "imbypass", "true")),
    ("r42", has(r"://img\.nbc\.com/"), _with_query("impolicy=original")),
    ("r43", has(rf"//is\d*\.fwrdassets\.com/images/p/.*{IMG}"), _with_query("impolicy=original")),
    ("r44", has(rf"//is\d*\.revolveassets\.com/images/p\d*/n/[a-z]+/.*{IMG}"), lambda u: F.concat(F.regexp_replace(bare(u), r"(/images/p\d*/n/)[a-z]+/", "$1z/"), F.lit("?impolicy=original"))),
    ("r45", has(r"/media-library/.*[?&]id=\d+"), lambda u: F.concat(F.lit("https://assets.rbl.ms/"), F.regexp_extract(u, r"[?&]id=(\d+)", 1), F.lit("/origin."), F.regexp_extract(bare(u), r"\.(\w+)$", 1))),
    ("r46", has(r"//(?:images\.squarespace-cdn\.com|static1\.squarespace\.com)/"), _squarespace),
    ("r47", has(r"//image\.goat\.com/"), _no_op(_goat)),
    ("r48", has(r"^https?://(?:is\d+(?:-ssl)?\.mzstatic\.com/image/thumb/.+/\d+x\d+[a-z]*(?:-\d+)?\.(?:jpe?g|png|tiff?|webp|bmp)(?:[?#].*)?$|a\d+\.mzstatic\.com/[a-z]{2}/r\d+/\d+/.+\.(?:jpe?g|png|tiff?|webp|bmp)(?:[?#].*)?$)"), _mzstatic),
    ("r49", has(rf"{IMG}\?"), bare),
)


def resolved(u: Column) -> Column:
    """struct(resolver, master) of the first resolver that gives another address; null where none does.

    Name and result travel as one text, so that each rewrite is evaluated once.
    """
    tagged = F.coalesce(*[F.when(cond(u), F.concat(F.lit(name + "|"), F.nullif(rewrite(u), F.lit("")))) for name, cond, rewrite in RESOLVERS])
    once = F.transform(F.array(tagged), lambda t: F.when(t.isNotNull(), F.struct(F.substring_index(t, "|", 1).alias("resolver"), F.substring(t, F.instr(t, "|") + 1, F.lit(1 << 30)).alias("master"))))
    return F.element_at(once, 1)


def by_table(urls, table, url: str):
    """(url, master) by an equi-join on the image's UUID with a per-site table (uuid, master), the first row of a UUID counting."""
    key = F.regexp_extract(F.col(url), r"/([a-f0-9]{8}-[a-f0-9-]{27})/([a-f0-9]{8}-[a-f0-9-]{27})/", 2)
    first = table.groupBy("uuid").agg(F.min_by("master", "ordinal").alias("master"))
    return urls.withColumn("_uuid", key).join(first, F.col("_uuid") == first["uuid"], "left").drop("_uuid", "uuid")
