"""Several values packed in one field, split into one row per value.

The splitter works on the Arrow string buffers of a batch: character classes come from one pass of numpy
masks over all bytes, quote parity and delimiter masks over the whole buffer decide where values end, and
the child offsets so found make a list array that is flattened with the parents' ordinals. There is no
Python loop over rows or characters.

Defined results: null, empty and blank fields hold no value; a field with one value gives no rows; empty
values count neither as item nor for the position; an opening quote without its closing one is text.
Numbers with a decimal comma stay whole as far as the row's other marks and numbers tell them from a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks that separate values, strongest first ('/' only where no other mark does).
MARKS = (",", ";", "|", "\t", "\n", "\r", "·", "»", ">", "+", "/")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def _rows_of(offsets: np.ndarray, n: int) -> np.ndarray:
    """The row of each byte."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) if n else np.zeros(0, np.int64)


def _shift(x: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full_like(x, fill)
    if by > 0:
        out[by:] = x[:-by]
    elif by < 0:
        out[:by] = x[-by:]
    return out


def _decimal_commas(data: np.ndarray, row: np.ndarray, mark: np.ndarray, slash: np.ndarray, space: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Commas within a number, told by the row's other marks and by the sizes of the numbers.

    A comma between digits is a decimal one if the numbers beside it stand free and something else parts the
    row's values: with a mark of another kind, or commas before a blank, it is if one digit follows, or two that
    make quarters or no number of the row's size; with slashes if a half or quarter follows. Where bare commas
    are all there is, they part the values, unless the digit behind is far below the number before (40,5).
    Runs such as 3,4,5 are lists.
    """
    n, out = len(data), np.zeros(len(data), bool)
    comma = mark & (data == 44)
    c = np.flatnonzero(comma[1:-1] & DIGIT[data[:-2]] & DIGIT[data[2:]]) + 1 if n > 2 else np.zeros(0, np.int64)
    c = c[(row[c - 1] == row[c]) & (row[c + 1] == row[c])]
    if not len(c):
        return out
    pos, digit = np.arange(n), DIGIT[data]
    first = np.maximum.accumulate(np.where(digit & ~(_shift(digit, 1, False) & (_shift(row, 1, -1) == row)), pos, 0))
    last = np.minimum.accumulate(np.where(digit & ~(_shift(digit, -1, False) & (_shift(row, -1, -1) == row)), pos, n - 1)[::-1])[::-1]
    s, e = first[c - 1], last[c + 1]

    def at(i: np.ndarray) -> np.ndarray:
        """The byte at i, 0 outside of the row."""
        ok = (i >= 0) & (i < n)
        j = np.where(ok, i, 0)
        return np.where(ok & (row[j] == row[c]), data[j], 0)

    def value(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        v = np.zeros(len(c), np.int64)
        for k in range(4):
            v = np.where(k < size, v * 10 + at(start + k).astype(np.int64) - 48, v)
        return v

    wa, wb = c - s, e - c
    a, b = value(s, wa), value(c + 1, wb)
    before, after = at(s - 1), at(e + 1)
    letters = lambda x: ((x >= 65) & (x <= 90)) | ((x >= 97) & (x <= 122)) | (x >= 128)
    free = ~letters(before) & ~letters(after) & (before != 45) & (after != 45) & (before != 46) & (after != 46) & (wa <= 4) & (wb <= 2)
    numerator = at(s - 2)
    of_fraction = (before == 47) & DIGIT[numerator] & ~DIGIT[at(s - 3)] & (numerator - 48 < a) & np.isin(a, (2, 3, 4, 8, 16))
    mixed = SPACE[after] & DIGIT[at(e + 2)] & (at(e + 3) == 47)
    chain = ((before == 44) & DIGIT[at(s - 2)]) | ((after == 44) & DIGIT[at(e + 2)])
    free &= ~of_fraction & ~mixed
    rows = int(row[-1]) + 1
    has = lambda m: np.bincount(row[m], minlength=rows)[row[c]] > 0
    # marks at the edge of a field part nothing
    text = ~space & ~gap
    upto = np.cumsum(text)
    total = np.bincount(row[text], minlength=rows)
    left = upto - (np.cumsum(total) - total)[row]
    parts = (left > 0) & (left < total[row])
    comma_next = (_shift(data, -1, 0) == 44) & (_shift(row, -1, -1) == row)
    spaced = comma & SPACE[_shift(data, -1, 0)] & (_shift(row, -1, -1) == row)
    twice = comma & comma_next
    strong = has(mark & ~comma & parts) | (has(spaced & parts) & ~has(twice))
    quarter = np.isin(b, (25, 75)) & (wb == 2)
    out[c] = free & (
        (~chain & strong & ((wb == 1) | quarter | (b > 4 * a))) | (~chain & has(slash & parts) & (((wb == 1) & (b == 5)) | quarter)) | ((wb == 1) & (a >= 20))
    )
    return out


def split_buffers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the values and the row of each, from a string array's buffers."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    row = _rows_of(offsets, n)
    pos = np.arange(n)
    space = SPACE[data]
    # nearest bytes that are no white space, within the row
    last = np.maximum.accumulate(np.where(space, -1, pos))
    before = _shift(last, 1, -1)
    before = np.where((before >= 0) & (before >= offsets[row]), before, -1)
    nxt = np.minimum.accumulate(np.where(space, n, pos)[::-1])[::-1]
    after = _shift(nxt, -1, n)
    after = np.where(after < offsets[row + 1], after, -1)
    first_in, last_in = before < 0, after < 0

    # enclosing brackets count as white space
    opens, shuts = (data == ord("[")) & first_in & ~space, (data == ord("]")) & last_in & ~space
    has = np.zeros(len(offsets) - 1, bool)
    has[row[opens]] = True
    closed = np.zeros(len(offsets) - 1, bool)
    closed[row[shuts]] = True
    brackets = np.bincount(row[(data == ord("[")) | (data == ord("]"))], minlength=len(offsets) - 1)
    edge = (opens | shuts) & (has & closed & (brackets == 2))[row]

    # marks; two-byte marks are known by their second byte, the first then is blanked
    b1 = _shift(data, 1, 0)
    wide = ((data == 0xB7) | (data == 0xBB)) & (b1 == 0xC2)
    lead = _shift(wide, -1, False)
    mark = wide.copy()
    for m in ",;|\t\n\r>":
        mark |= data == ord(m)
    plus = (data == ord("+")) & SPACE[b1] & SPACE[_shift(data, -1, 0)]
    mark |= plus
    slash = data == ord("/")

    gap = mark | slash | edge | lead
    inside = np.zeros(n, bool)
    for quote in (34, 39):
        q = (data == quote) & ~inside
        if not q.any():
            continue
        run_start = q & ~(_shift(q, 1, False) & (_shift(row, 1, -1) == row))
        run_end = q & ~(_shift(q, -1, False) & (_shift(row, -1, -1) == row))
        starts, ends = pos[run_start], pos[run_end]
        length = ends - starts + 1
        b, a = before[starts], after[ends]
        opener = (b < 0) | gap[np.maximum(b, 0)]
        closer = (a < 0) | gap[np.maximum(a, 0)]
        # a run before text opens, one after text closes, one between gaps does what the parity so far asks for;
        # runs of even length before a gap are doubled quotes or enclose nothing
        odd = length % 2 == 1
        ev = np.flatnonzero((opener & (odd | ~closer)) | (closer & odd))
        if not len(ev):
            continue
        turn = opener[ev] & closer[ev]
        sets = opener[ev] & ~closer[ev]
        at, of, i = ev, row[starts[ev]], np.arange(len(ev))
        new = _shift(of, 1, -1) != of
        head = np.maximum.accumulate(np.where(new, i, 0))
        fixed = np.maximum.accumulate(np.where(turn, -1, i))
        known = fixed >= head
        turns = np.cumsum(turn)
        since = turns - np.where(known, turns[np.maximum(fixed, 0)], turns[head] - turn[head])
        state = (np.where(known, sets[np.maximum(fixed, 0)], False) ^ (since % 2 == 1)).astype(bool)
        before_state = _shift(state, 1, False) & ~new
        change = np.flatnonzero(state != before_state)
        # an opening counts if the row also closes it
        opens = state[change] & _shift(~state[change], -1, False) & (_shift(of[change], -1, -1) == of[change])
        first_open = change[opens]
        shut = change[_shift(opens, 1, False)]
        depth = np.zeros(n + 1, np.int32)
        np.add.at(depth, starts[at[first_open]], 1)
        np.add.at(depth, ends[at[shut]] + 1, -1)
        inside |= np.cumsum(depth[:-1]) > 0
    mark &= ~inside
    slash &= ~inside

    # marks that belong to a value: the decimal comma, the slash of a fraction
    d1, d2, d3 = b1, _shift(data, 2, 0), _shift(data, 3, 0)
    n1, n2 = (_shift(data, -k, 0) for k in (1, 2))
    fraction = DIGIT[d1] & SPACE[d2] & DIGIT[d3] & DIGIT[n1] & ~DIGIT[n2]
    mark &= ~_decimal_commas(data, row, mark, slash & ~fraction, space, gap)
    slash &= ~fraction
    other = np.zeros(len(offsets) - 1, bool)
    # a mark separates if text lies on both of its sides; at the edge of a field it parts nothing
    text = ~space & ~gap
    upto = np.cumsum(text)
    base = np.where(offsets[:-1] > 0, upto[np.maximum(offsets[:-1] - 1, 0)], 0)
    total = np.where(offsets[1:] > 0, upto[np.maximum(offsets[1:] - 1, 0)], 0) - base
    left = upto - base[row]
    parts = mark & (left > 0) & (left < total[row])
    other[row[parts]] = True
    mark |= slash & ~other[row]

    # values lie between cuts; outer white space, brackets and enclosing quotes go
    cut = mark | (lead & _shift(mark, -1, False)) | edge
    filled = ~cut & ~space
    seg_start = np.concatenate([offsets[:-1], pos[cut] + 1])
    seg_end = np.concatenate([offsets[1:], pos[cut]])
    seg_start.sort()
    seg_end.sort()
    last = np.maximum.accumulate(np.where(filled, pos, -1))
    nxt = np.minimum.accumulate(np.where(filled, pos, n)[::-1])[::-1]
    keep = seg_start < seg_end
    s, e = seg_start[keep], seg_end[keep]
    s2, e2 = nxt[s], last[e - 1] + 1
    keep = (s2 < e) & (e2 > s)
    s, e = s2[keep], e2[keep]
    empty = (e - s == 2) & ((data[s] == 34) | (data[s] == 39)) & (data[s] == data[e - 1])
    s, e = s[~empty], e[~empty]
    wrapped = (e - s >= 2) & ((data[s] == 34) | (data[s] == 39)) & (data[s] == data[e - 1]) & inside[s] & inside[e - 1]
    s, e = s + wrapped, e - wrapped
    # white space just inside of quotes
    trimmed = np.minimum.accumulate(np.where(space, n, pos)[::-1])[::-1]
    tail = np.maximum.accumulate(np.where(space, -1, pos))
    keep = s < e
    s, e = s[keep], e[keep]
    s, e = np.minimum(trimmed[s], e), np.maximum(tail[e - 1] + 1, s)
    keep = s < e
    return s[keep], e[keep], row[s[keep]]


def split_column(values: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Items, their parents' ordinals and their positions from 1, of the fields with two values or more."""
    values = values.cast(pa.large_string()).fill_null("")
    if values.offset or len(values) == 0:
        values = pa.concat_arrays([pa.array([], pa.large_string()), values])
    _, off, buf = values.buffers()
    offsets = np.frombuffer(off, np.int64, len(values) + 1).copy() if off and len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(buf, np.uint8, offsets[-1])[: offsets[-1]] if buf else np.zeros(0, np.uint8)
    s, e, parent = split_buffers(data, offsets)
    counts = np.bincount(parent, minlength=len(values)) if len(values) else np.zeros(0, np.int64)
    keep = counts[parent] >= 2
    s, e, parent = s[keep], e[keep], parent[keep]
    # child buffer: the bytes of all values one behind the other
    size = e - s
    child = np.zeros(len(s) + 1, np.int64)
    np.cumsum(size, out=child[1:])
    index = np.repeat(s - child[:-1], size) + np.arange(child[-1])
    items = pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(child.tobytes()), pa.py_buffer(data[index].tobytes())])
    items = pa.compute.replace_substring(items, '""', '"')
    counts = np.bincount(parent, minlength=len(values)) if len(values) else np.zeros(0, np.int64)
    starts = np.zeros(len(values) + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    lists = pa.LargeListArray.from_arrays(pa.array(starts), items)
    ordinals = np.arange(len(parent)) - starts[parent] + 1 if len(parent) else np.zeros(0, np.int64)
    return lists.flatten(), parent, ordinals


def unpack(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per value: key, field_name, pos (from 1) and item; df may have any other columns."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0)
            for i, f in enumerate(fields):
                items, parent, at = split_column(b.column(i + 1))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(parent, pa.int64())), pa.array([f] * len(parent), pa.string()), pa.array(at, pa.int32()), items.cast(pa.string())], names=["_k", "field_name", "pos", "item"])

    narrow = df.select(F.col(key).alias("_k"), *[F.col(f).cast("string").alias(f"_v{i}") for i, f in enumerate(fields)])
    out = narrow.mapInArrow(run, f"_k {key_type}, field_name string, pos int, item string")
    return out.withColumnRenamed("_k", key)
