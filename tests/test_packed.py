import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archivolt.operators.packed import split_column, unpack


def split(*values):
    items, parent, at = split_column(pa.array(values, pa.string()))
    out = [[] for _ in values]
    for i, x, n in zip(parent, items.to_pylist(), at):
        out[i].append(x)
        assert n == len(out[i])
    return out


def test_marks_quotes_and_brackets():
    assert split('"30""" | "28"""', "XS/S | M/L", '28", 30"; 32"', "S / M / ", ' ["S","M, tall"] ', "'6 7/8','7'") == [['30"', '28"'], ["XS/S", "M/L"], ['28"', '30"', '32"'], ["S", "M"], ["S", "M, tall"], ["6 7/8", "7"]]
    assert split("38,5 / 39", "7,7 1/2,8", "a » b · c", "A > B > ", "XS/S", '"", x, y', "38 + 38,5") == [["38,5", "39"], ["7", "7 1/2", "8"], ["a", "b", "c"], ["A", "B"], ["XS", "S"], ["x", "y"], ["38", "38,5"]]
    assert split("Accessories | | Belts", '"Home, Kitchen",Textiles', '"M, L, XL') == [["Accessories", "Belts"], ["Home, Kitchen", "Textiles"], ['"M', "L", "XL"]]


def test_nothing_to_split():
    assert split(None, "", "   ", "One Size", '["a"]', ",,;", "") == [[], [], [], [], [], [], []]
    assert split() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text("abcé 1", min_size=1, max_size=6).map(str.strip).filter(bool), min_size=2, max_size=5), min_size=1, max_size=6), st.sampled_from([";", "|", "\t", " · ", " » "]))
def test_round_trip(rows, mark):
    assert split(*[mark.join(r) for r in rows]) == [[" ".join(x.split(" ")) for x in r] for r in rows]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text('ab,;|"/ ', min_size=1, max_size=6).map(str.strip).filter(bool), min_size=2, max_size=4).filter(lambda r: all(x.strip('"') for x in r)))
def test_quoted_round_trip(row):
    text = ";".join('"' + x.replace('"', '""') + '"' for x in row)
    assert split(text) == [row]


def test_dataframe(spark):
    df = spark.createDataFrame([(1, "a;b", "x"), (2, None, "p > q"), (3, "", None)], "id long, f string, pos string").withColumnRenamed("pos", "g").selectExpr("*", "'z' as item", "1 as _k2")
    got = {tuple(r) for r in unpack(df, "id", ["f", "g"]).collect()}
    assert got == {(1, "f", 1, "a"), (1, "f", 2, "b"), (2, "g", 1, "p"), (2, "g", 2, "q")}
    assert unpack(df.filter("id > 9"), "id", ["f"]).count() == 0


@pytest.mark.parametrize("text, want", [
    ("3,4,5,6", ["3", "4", "5", "6"]), ("4,5,6", ["4", "5", "6"]), ("7,75; 8", ["7,75", "8"]), ("10,5; 11", ["10,5", "11"]), ("1 1/2, 2", ["1 1/2", "2"]), ("28,, 30,32", ["28", "30", "32"]), ("38/38,5/39", ["38", "38,5", "39"]), ("9/9,5/10", ["9", "9,5", "10"]),
    ("6,7 1/8,8", ["6", "7 1/8", "8"]), ("7,5, 8, 8,5", ["7,5", "8", "8,5"]), ("40,5", []), ("38,5,39", ["38,5", "39"]), ("28x30,30x32;1x2", ["28x30", "30x32", "1x2"]), ("6/7,8/9", ["6/7", "8/9"]), ("35-38,39-42; 43-46", ["35-38", "39-42", "43-46"]), ('"38,5", 39', ["38,5", "39"]), ("3,4,5; 6", ["3", "4", "5", "6"]),
])
def test_decimal_commas(text, want):
    for around in ([text], [text, "5,5;6"], ["9;5", text, "12"], [None, text, ""]):  # neighbours in the buffer tell nothing
        items, parent, _ = split_column(pa.array(around))
        assert [x for x, p in zip(items.to_pylist(), parent) if p == around.index(text)] == want
