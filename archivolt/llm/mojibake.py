"""Text decoded with a wrong character set: found and, where it can be known, restored.

Noisy-channel decoding. A piece (a run of letters, digits, non-ASCII characters and numeric escapes) is put
back into bytes under each character set it may have been misread in; the bytes form a lattice whose edges
are whole UTF-8 characters, kept characters and wildcards for what is left of a character that lost bytes.
The words of the whole corpus with the piece's ASCII skeleton are spelled through the lattice by a Viterbi
search, and the cheapest way of each competes under the word's frequency: a right letter beside a damaged
one is kept, and any number of bytes may be lost. Readings that decode all they can need no known word and
compete as well, by word, by token and, for pieces without any ASCII, by masked word. A field's pieces then
form a second lattice, searched by Viterbi: states are the channels and 'clean', a change of channel costs,
so the pieces of a field agree on what happened to it. Per piece and channel only the best reading matters to
that search, so no other is kept.

All counts cover all rows. Candidate work is done once per distinct piece, in tasks; nothing of corpus size
is broadcast or collected.

Defined results: null, empty and ASCII-only fields are no case; right letters in any script and letters that
are only escaped are none; U+FFFD always is one; a field is restored as far as its pieces can be, unknown
characters stay U+FFFD.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.session import materialize

PIECE = r"(?:[A-Za-z0-9]|[^\x00-\x7F]|&#\d{1,6};|&#[xX][0-9A-Fa-f]{1,5};|&[A-Za-z]{2,8}\d{0,2};|\\u[0-9A-Fa-f]{4})+"
SUSPECT = r"[^\x00-\x7F]|&#\d{1,6};|&#[xX][0-9A-Fa-f]{1,5};|&[A-Za-z]{2,8}\d{0,2};|\\u[0-9A-Fa-f]{4}"
TOKEN = re.compile(r"[^\W_]+|[^\x00-\x7f]")
WILD = 0xE000  # private-use characters stand for wildcards: + lead byte, + 0xFF for any character
# Character sets text is misread in, with the log-probability of each channel.
UTF8_AS = {"cp1252": -0.7, "latin-1": -1.5, "mac_roman": -2.0, "cp437": -2.0, "cp850": -2.0, "cp1251": -2.0, "cp1250": -3.0, "koi8_r": -3.0, "cp866": -3.0}
CONFUSED = {("mac_roman", "cp1252"): -2.0, ("cp437", "cp1252"): -3.0, ("cp850", "cp1252"): -3.0, ("cp1251", "cp1252"): -3.5, ("cp1252", "mac_roman"): -3.0, ("cp1252", "cp850"): -3.5, ("cp1252", "cp437"): -3.5}
TWICE, LOST, KEPT = -0.7, -1.0, 0.7
UNSEEN = 0.01


def _table(charset: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)  # undefined bytes come through as controls
    return out


TABLES = {c: _table(c) for c in {*UTF8_AS, *(x for pair in CONFUSED for x in pair)}}
# C1 controls occur beside characters of the Windows set where only some bytes were undefined
TABLES["cp1252"] |= {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in TABLES["cp1252"]}
BACK = {c: {b: ch for ch, b in reversed(TABLES[c].items())} for c in TABLES}


def unescaped(piece: str) -> str:
    return html.unescape(re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m.group(1), 16)), piece)) if "&" in piece or "\\" in piece else piece


def utf8_reading(s: str, charset: str) -> tuple[str, int, int]:
    """The way through the byte lattice that takes every whole character: reading, characters decoded, bytes lost."""
    table, out, i, whole, lost = TABLES[charset], [], 0, 0, 0
    n = len(s)
    while i < n:
        b = table.get(s[i])
        need = 1 if b is not None and 0xC2 <= b < 0xE0 else 2 if b is not None and 0xE0 <= b < 0xF0 else 3 if b is not None and 0xF0 <= b < 0xF5 else 0
        if not need:
            out.append(s[i])
            i += 1
            continue
        tail = []
        while len(tail) < need and i + 1 + len(tail) < n and 0x80 <= (table.get(s[i + 1 + len(tail)]) or 0) < 0xC0:
            tail.append(table[s[i + 1 + len(tail)]])
        try:
            c = bytes([b, *tail]).decode("utf-8") if len(tail) == need else None
        except UnicodeDecodeError:
            c = None
        if c:
            out.append(c)
            whole += 1
        else:
            out.append(chr(WILD + b))
            lost += 1
        i += 1 + len(tail)
    return "".join(out), whole, lost


def readings(piece: str) -> list[tuple[str, str, float, int]]:
    """(channel, reading, log-probability of the channel, strength of its structure) of a piece but as it stands."""
    s = unescaped(piece)
    out: dict[str, tuple[str, float, int]] = {}

    def add(channel: str, text: str, p: float, strength: int) -> None:
        if text != s and (text not in out or out[text][1] < p):
            out[text] = (channel, p, strength)

    if "�" in s:
        add("replaced", s.replace("�", chr(WILD + 0xFF)), LOST, 9)
    if not all(ord(c) < 128 for c in s):
        for charset, p in UTF8_AS.items():
            text, whole, lost = utf8_reading(s, charset)
            if lost:
                add(charset, text, p + LOST * lost, whole)
            elif whole:
                add(charset, text, p, whole)
                twice, again, lost = utf8_reading(text, "cp1252")
                if again:
                    add(charset + "+cp1252", twice, p + TWICE + LOST * lost, whole + again)
                elif lost:
                    add(charset + "+cp1252", twice, p + TWICE + LOST * lost, whole)
        for (a, b), p in CONFUSED.items():
            text = "".join(BACK[b].get(TABLES[a][c], c) if c in TABLES[a] else c for c in s)
            add(f"{a}/{b}", text, p, 0)
    return [(c, t, p, k) for t, (c, p, k) in out.items()]


def lattice(s: str, charset: str) -> list[list[tuple[int, str, str, bytes]]]:
    """The edges from each place of a piece: (place after, what it gives, kind, bytes known).

    A character put back into its byte may be kept as it is, may begin a whole UTF-8 character, may be what is
    left of one whose last bytes are lost ('lead': the first bytes are known), or of one whose first bytes are
    lost ('last'). U+FFFD stands for any character. ASCII is kept.
    """
    table, n, out = TABLES[charset], len(s), []
    for i, c in enumerate(s):
        edges = [(i + 1, c, "kept", b"")]
        b = table.get(c) if c > "\x7f" else None
        if c == "�":
            edges = [(i + 1, "", "any", b"")]
        elif b is not None and 0x80 <= b < 0xC0:
            edges.append((i + 1, "", "last", bytes([b])))
        elif b is not None and 0xC2 <= b < 0xF5:
            need, known = (1 if b < 0xE0 else 2 if b < 0xF0 else 3), bytes([b])
            for j in range(need + 1):
                if j == need:
                    try:
                        edges.append((i + 1 + j, known.decode("utf-8"), "whole", known))
                    except UnicodeDecodeError:
                        pass
                    break
                edges.append((i + 1 + j, "", "lead", known))
                x = table.get(s[i + 1 + j]) if i + 1 + j < n and s[i + 1 + j] > "\x7f" else None
                if x is None or not 0x80 <= x < 0xC0:
                    break
                known += bytes([x])
        out.append(edges)
    return out


def spelled(edges: list[list[tuple[int, str, str, bytes]]], word: str) -> tuple[float, int, int] | None:
    """(cost, whole characters, lost ones) of the cheapest way through a lattice that spells the word, by Viterbi; None if none does or all is kept."""
    m = len(word)
    ways: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(len(edges) + 1)]
    ways[0][0] = (0.0, 0, 0)
    for i, each in enumerate(edges):
        for k, (cost, whole, lost) in ways[i].items():
            if k == m:
                continue
            w = word[k]
            for to, text, kind, known in each:
                if kind == "kept":
                    fits, step = text.lower() == w, (cost + (0.0 if text < "\x80" else KEPT), whole, lost)
                elif kind == "whole":
                    fits, step = text.lower() == w, (cost, whole + 1, lost)
                else:
                    code = w.encode("utf-8", "replace")
                    fits, step = w > "\x7f" and (kind == "any" or (code.startswith(known) if kind == "lead" else code.endswith(known))), (cost - LOST, whole, lost + 1)
                if fits and step[0] < ways[to].get(k + 1, (math.inf,))[0]:
                    ways[to][k + 1] = step
    best = ways[-1].get(m)
    return best if best and best[1] + best[2] else None


def skeleton(low: str) -> str | None:
    """A word's ASCII with each run of other characters as '*': what no damage of the kinds above changes; None without ASCII letters and digits."""
    s = re.sub(r"[^\x00-\x7f]+", "*", low)
    return s if "*" in s and re.search("[a-z0-9]", s) else None


def masks(word: str) -> list[str]:
    """The word with its non-ASCII characters masked, by lead byte and wholly."""
    if word.isascii() or any(0xE000 <= ord(c) < 0xE100 for c in word):
        return []
    by_lead = "".join(c if c.isascii() else chr(WILD + c.encode("utf-8", "replace")[0]) for c in word)
    return [by_lead, "".join(c if c.isascii() else chr(WILD + 0xFF) for c in word)]


def mask_of(reading: str) -> str:
    """The mask a reading with wildcards looks for; where it also keeps non-ASCII characters, these are masked alike."""
    any_ = chr(WILD + 0xFF) in reading
    return "".join(c if c.isascii() else chr(WILD + 0xFF) if any_ else c if 0xE000 <= ord(c) < 0xE100 else chr(WILD + c.encode("utf-8", "replace")[0]) for c in reading.lower())


def has_wild(s: str) -> bool:
    return any(0xE000 <= ord(c) < 0xE100 for c in s)


def shaped(word: str, like: str) -> str:
    """A word in the letter case of a damaged piece."""
    letters = [c for c in like if c.isascii() and c.isalpha()]
    if letters and all(c.isupper() for c in letters) and len(letters) > 1:
        return word.upper()
    return word.lower() if letters and like[0].isascii() and all(c.islower() for c in letters) else word


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Dictionary entries of each distinct piece: its word, its tokens, its masks."""
    for f in frames:
        rows = []
        for piece, n in zip(f["piece"], f["n"]):
            s = unescaped(piece)
            low = s.lower()
            rows.append(("p:" + low, n, s))
            tokens = TOKEN.findall(low)
            if len(tokens) > 1 or tokens != [low]:
                rows += [("p:" + t, n, t) for t in tokens if not t.isascii()]
            rows += [("m:" + m, n, s) for m in masks(low)] if "�" not in low else []
        yield pd.DataFrame(rows, columns=["key", "n", "word"])


def _wanted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys that each reading of each distinct piece looks up; the piece as it stands is the channel ''."""
    for f in frames:
        rows = []
        for piece in f["piece"]:
            found = readings(piece)
            if not found:
                continue
            for channel, text, p, strength in [("", unescaped(piece), 0.0, 0), *found]:
                low = text.lower()
                if has_wild(low):
                    rows.append((piece, channel, text, p, strength, "m:" + mask_of(text), "m"))
                else:
                    rows.append((piece, channel, text, p, strength, "p:" + low, "p"))
                    tokens = TOKEN.findall(low)
                    if strength and (len(tokens) > 1 or tokens != [low]):
                        rows += [(piece, channel, text, p, strength, "p:" + t, "t") for t in tokens if not t.isascii()]
        yield pd.DataFrame(rows, columns=["piece", "channel", "reading", "p", "strength", "key", "kind"])


def _skeletons(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, low, word, n): words that may be what a damaged piece of the same skeleton was."""
    for f in frames:
        rows = []
        for piece, n in zip(f["piece"], f["n"]):
            s = unescaped(piece)
            if "�" not in s and (key := skeleton(s.lower())):
                rows.append((key, s.lower(), s, n))
        yield pd.DataFrame(rows, columns=["key", "low", "word", "n"])


def _sought(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        keys = [skeleton(unescaped(p).lower()) for p in f["piece"]]
        yield pd.DataFrame([(p, k) for p, k in zip(f["piece"], keys) if k], columns=["piece", "key"])


def _spelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Readings of a piece as a word, by each character set whose lattice spells it."""
    for f in frames:
        rows, at, last = [], {}, None
        for piece, low, word, n in zip(f["piece"], f["low"], f["word"], f["n"]):
            s = unescaped(piece)
            if s.lower() == low:
                continue
            if piece != last:
                at, last = {}, piece
            for charset, p in UTF8_AS.items():
                if charset not in at:
                    at[charset] = lattice(s, charset)
                if way := spelled(at[charset], low):
                    rows.append((piece, charset, shaped(word, s), p - way[0], way[1], n))
        yield pd.DataFrame(rows, columns=["piece", "channel", "reading", "p", "strength", "n"])


def _judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Log-odds of each reading against the piece as it stands."""
    for f in frames:
        out = []
        for piece, total, cands in zip(f["piece"], f["total"], f["cands"]):
            own, best = UNSEEN, []
            groups: dict[tuple, list] = {}
            for c in cands:
                groups.setdefault((c["channel"], c["reading"], c["p"], c["strength"]), []).append(c)
            for (channel, _, _, _), hits in groups.items():
                if not channel:
                    own = max(own, *(h["n"] or 0 for h in hits))
            as_is = unescaped(piece)
            seen = any(c["channel"] and c["kind"] == "p" and c["n"] for c in cands)
            for (channel, reading, p, strength), hits in groups.items():
                if not channel:
                    continue
                whole = max((h["n"] or 0 for h in hits if h["kind"] in "pmv"), default=0)
                tokens = [h["n"] or 0 for h in hits if h["kind"] == "t"]
                count = whole
                if not whole and tokens and strength:
                    plain = sum(t.isascii() for t in TOKEN.findall(reading))
                    count = math.exp(sum(math.log(n + UNSEEN) for n in tokens) - (len(tokens) - 1) * math.log(max(total, 2)) + plain * math.log(UNSEEN))
                    count = max(count, UNSEEN * min(tokens))
                text = reading
                if has_wild(reading):
                    word = next((h["word"] for h in hits if h["kind"] == "m" and h["word"]), None)
                    if word is not None and word.lower() == as_is.lower():
                        continue
                    text = shaped(word, as_is) if word else "".join("�" if 0xE000 <= ord(c) < 0xE100 else c for c in reading)
                    if not word and "�" not in as_is:
                        continue
                elif reading.lower() == as_is.lower():
                    continue
                # whole characters are evidence of their own: how often the damage recurs then counts by its root
                known = 0.5 * math.log(own + 1) if strength and not has_wild(reading) else math.log(own + UNSEEN)
                odds = math.log(count + UNSEEN) + p - known
                if strength >= 3 and not has_wild(reading) and not seen:
                    odds = max(odds, 1.0)  # so many whole characters do not come about by chance
                if "�" in as_is:
                    odds = max(odds, 1.0) + (5 if channel == "replaced" and whole else 0)
                best.append((channel, text, odds))
            top: dict[str, tuple] = {}  # the Viterbi search takes the best of each channel
            for o in best:
                if o[2] > -3 and (o[0] not in top or (o[2], o[1]) > (top[o[0]][2], top[o[0]][1])):
                    top[o[0]] = o
            if any(o[2] > 0 for o in top.values()):
                out.append((piece, [{"channel": c, "reading": t, "odds": o} for c, t, o in sorted(top.values(), key=lambda o: (-o[2], o[0]))]))
        yield pd.DataFrame(out, columns=["piece", "options"])


def viterbi(pieces: list[list[dict]], change: float = 1.5, enter: float = 0.3) -> list[dict | None]:
    """The best option of each piece (None: as it stands), a change of channel costing."""
    states: dict[str, tuple[float, list]] = {"": (0.0, [])}
    for options in pieces:
        emit: dict[str, tuple[float, dict | None]] = {"": (0.0, None)}
        for o in options:
            if o["channel"] not in emit or emit[o["channel"]][0] < o["odds"]:
                emit[o["channel"]] = (o["odds"], o)
        step = {}
        for to, (e, o) in emit.items():
            cost = lambda frm: 0.0 if frm == to else enter if not frm or not to else change  # noqa: B023, E731
            score, frm = max((v - cost(k), k) for k, (v, _) in states.items())
            step[to] = (score + e, [*states[frm][1], o])
        states = step
    return max(states.values(), key=lambda x: x[0])[1]


def damaged(fields: DataFrame) -> DataFrame:
    """(src_table, row_id, field_name, text, restored) of the damaged fields; fields: (src_table, row_id, field_name, text)."""
    pieces = F.filter(F.regexp_extract_all("text", F.lit("(" + PIECE + ")"), F.lit(1)), lambda p: p.rlike(SUSPECT))
    each = fields.filter(F.col("text").rlike(SUSPECT)).select("src_table", "row_id", "field_name", F.posexplode(pieces).alias("pos", "piece"))
    counts = materialize(each.groupBy("piece").agg(F.count("*").alias("n")))
    words = counts.mapInPandas(_keys, "key string, n long, word string").groupBy("key", "word").agg(F.sum("n").alias("n")).groupBy("key").agg(F.when(F.col("key").startswith("m:"), F.max("n")).otherwise(F.sum("n")).alias("n"), F.max_by("word", F.struct("n", "word")).alias("word"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    wanted = counts.select("piece").mapInPandas(_wanted, "piece string, channel string, reading string, p double, strength int, key string, kind string")
    corpus = counts.mapInPandas(_skeletons, "key string, low string, word string, n long").groupBy("key", "low").agg(F.max_by("word", F.struct("n", "word")).alias("word"), F.sum("n").alias("n"))
    sought = counts.select("piece").mapInPandas(_sought, "piece string, key string")
    read = sought.join(corpus, "key").mapInPandas(_spelled, "piece string, channel string, reading string, p double, strength int, n long")
    read = read.groupBy("piece", "channel").agg(F.max_by(F.struct("reading", "p", "strength", "n"), F.struct(F.log(F.col("n")) + F.col("p"), F.col("reading"))).alias("b"))
    none = F.lit(None).cast("string")
    found = wanted.join(words, "key", "left").select("piece", "channel", "reading", "p", "strength", "kind", "n", "word").unionByName(read.select("piece", "channel", "b.reading", "b.p", "b.strength", F.lit("v").alias("kind"), "b.n", none.alias("word")))
    looked = found.groupBy("piece").agg(F.collect_list(F.struct("channel", "reading", "p", "strength", "kind", "n", "word")).alias("cands"))
    options = materialize(looked.crossJoin(F.broadcast(total)).mapInPandas(_judged, "piece string, options array<struct<channel:string,reading:string,odds:double>>"))
    hit = each.join(options, "piece").groupBy("src_table", "row_id", "field_name").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "options"))).alias("pieces"))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            restored, keep = [], []
            for ps in f["pieces"]:
                ps = [{"piece": p["piece"], "options": [dict(o) if isinstance(o, dict) else o.asDict() for o in p["options"]]} for p in ps]
                chosen = viterbi([p["options"] for p in ps])
                swap = {p["piece"]: o["reading"] for p, o in zip(ps, chosen) if o}
                keep.append(bool(swap))
                restored.append([{"damaged": a, "original": b} for a, b in sorted(swap.items(), key=lambda x: -len(x[0]))])
            out = f[["src_table", "row_id", "field_name"]].assign(swaps=restored)
            yield out[keep]

    return hit.mapInPandas(decide, "src_table string, row_id long, field_name string, swaps array<struct<damaged:string,original:string>>")


def restored(fields: DataFrame, found: DataFrame) -> DataFrame:
    """(src_table, row_id, field_name, text, restored)."""
    text = F.aggregate("swaps", F.col("text"), lambda t, s: F.replace(t, s["damaged"], s["original"]))
    return fields.join(found, ["src_table", "row_id", "field_name"]).select("src_table", "row_id", "field_name", "text", text.alias("restored"))


def text_fields(products: DataFrame, catalog: DataFrame) -> DataFrame:
    pm = products.select(F.lit("product_metadata").alias("src_table"), F.col("meta_id").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("name", "description")])).alias("x")).select("src_table", "row_id", "x.field_name", "x.text")
    return pm.unionByName(catalog.select(F.lit("catalog_entry").alias("src_table"), F.col("cat_id").alias("row_id"), F.lit("brand").alias("field_name"), F.col("brand").alias("text")))
