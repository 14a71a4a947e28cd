import difflib
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archivolt.operators import capture, catalog, groups, ledger, resolve, series
from archivolt.sources import readers, writers
from archivolt.streaming import stateful


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_capture_lines_and_filter(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("w\t20200101\thttp://a/products/x?ref=1\t200\ttext/html\nw 20200102 http://a/products/x 200 text/html\nw\t2\thttp://a/robots.txt\t200\ttext/html\nw\t3\thttp://a/y\t301\tTEXT/CSS\nw\t4\thttp://a/z\t200\tTEXT/CSS\nw\t5\thttp://a/a.js\t200\ttext/html\nw\t6\thttp://a/a.json\t200\ttext/html\nshort line\n")
    c = readers.capture_lines(spark, str(p))
    assert c.count() == 7
    kept, stats = capture.filter_captures(c)
    assert dict(rows(stats)) == {"kept": 3, "junk_path": 1, "status": 1, "mime": 1, "static_ext": 1}
    assert rows(capture.best_per_path(kept), "path", "tier", "ts") == [("/a.json", 2, "6"), ("/products/x", 4, "20200102")]
    again = capture.best_per_path(kept.repartition(7))
    assert rows(again) == rows(capture.best_per_path(kept.repartition(1)))


def test_product_index(spark):
    c = spark.createDataFrame([("w1", "2019", "http://a/products/x", "200", "text/html"), ("w2", "2018", "http://a:80/products/x/", "200", "text/html"), ("w3", "2017", "http://a/collections/c/products/x", "200", "text/html"), ("w4", "2017", "http://a/products/x.json", "200", "text/html"), ("w5", "2016", "http://a/products/%22", "200", "text/html"), ("w6", "2015", "http://a/products/y", "404", "text/html")], "replay_url string, ts string, original_url string, status string, mime string")
    rules = [{"path_prefix": "/products/", "url_type": "slug", "require_status": "200"}, {"path_contains": "/collections/", "url_type": "collection"}]
    got = capture.product_index(c, rules, [{"condition": "default", "era": "e"}])
    assert rows(got, "slug", "ts", "original_url", "all_types", "snapshot_count") == [("x", "2018", "https://a/products/x", ["collection", "slug"], 3)]
    assert capture.product_index(c.limit(0), rules, []).count() == 0
    got = capture.all_snapshots(c, c.limit(1).selectExpr("'x' as slug"))
    assert rows(got, "slug", "nth", "ts") == [("x", 1, "2017"), ("x", 2, "2018"), ("x", 3, "2019")]
    many = spark.createDataFrame([("k" if i % 3 else None, f"{2010 + i % 4}{i % 12 + 1:02d}", str(i)) for i in range(90)], "k string, ts string, u string")
    for k in ("k", None):
        seen = [r for r in capture.numbered(many, "k", "ts", "u").collect() if r["k"] == k]
        assert [r["nth"] for r in sorted(seen, key=lambda r: (r["ts"], r["u"]))] == list(range(1, len(seen) + 1))


def test_content_pages_and_labels(spark):
    c = spark.createDataFrame([("w", "1", "http://A.com/collections/x/?p=1", "200", "text/html"), ("w", "2", "http://a.com", "200", "text/html"), ("w", "3", "http://a.com/products/y", "200", "text/html"), ("w", "4", "http://a.com/products.json", "200", "application/json")], "replay_url string, ts string, original_url string, status string, mime string")
    assert [r[0] for r in rows(capture.content_pages(c), "page")] == ["a.com/", "a.com/collections/x", "a.com/products.json"]
    assert rows(capture.api_captures(c, ["/products.json"]), "ts", "label") == [("4", "products.json")]


def test_upsert_replays(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, v string, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", "z")], "id int, v string, w string")
    once = ledger.upsert(old, new, ["id"], prefer_old=("w",))
    assert rows(once) == [(1, "a", None), (2, "b", "x"), (3, "c", "z")]
    assert rows(ledger.upsert(once, new, ["id"], prefer_old=("w",))) == rows(once)
    assert rows(ledger.upsert(old, new, ["id"], overwrite=("v", "w"))) == [(1, "a", None), (2, None, "y"), (3, "c", "z")]
    assert rows(ledger.insert_ignore(old, new.union(new), ["id"])) == [(1, "a", None), (2, "b", "x"), (3, "c", "z")]
    assert rows(ledger.update(old, spark.createDataFrame([(1, "m"), (9, "n")], "id int, w string"), ["id"], "w")) == [(1, "a", "m"), (2, "b", "x")]
    assert rows(ledger.delete(old, new, ["id"])) == [(1, "a", None)]


def test_retry_queue_and_audit(spark):
    a = spark.createDataFrame([("u", "1", "throttle"), ("u", "2", "ok"), ("v", "1", "ok"), ("v", "2", "http_5xx"), ("w", "1", "http_404"), ("x", "1", "network"), ("x", "1", "ok")], "url string, attempted_at string, failure_class string")
    assert rows(ledger.retry_queue(a), "url") == [("v",), ("x",)]
    e = spark.createDataFrame([("s", None), ("t", "2020")], "slug string, resolved_at string")
    one = ledger.audit(e, spark.createDataFrame([("h", None)], "host string, cdx_dumped_at string"), spark.createDataFrame([], "url string, parsed_at string"), a)
    assert rows(one, "unresolved_slugs", "unenumerated_hosts", "unexpanded_surfaces", "retry_queue_depth", "status") == [(1, 1, 0, 2, "open")]
    assert rows(ledger.next_stage(one)) == [("retry_queue_depth", 2, "fetch")]


def test_breaker_and_rate(spark):
    a = spark.createDataFrame([("d", i, i == 4) for i in range(14)], "d string, i int, ok boolean")
    got = {r["i"]: r for r in ledger.breaker(a, "d", ["i"], "ok").collect()}
    assert [got[2]["pause_s"], got[3]["failures"], got[4]["failures"], got[7]["pause_s"], got[10]["pause_s"]] == [120, 4, 0, 120, 300]
    assert not got[13]["tripped"]
    r = {x["i"]: x["rate"] for x in ledger.error_rate(a, "d", "i", "ok", 100, 10, 10).collect()}
    assert r[8] is None and r[9] == 0.9 and r[13] == 0.9


def test_series(spark):
    p = spark.createDataFrame([("s", 0, 0), ("s", 1, 10), ("s", 2, None), ("s", 3, 10), ("s", 4, 5), ("s", 5, 6000000000), ("s", 6, 1)], "k string, seq int, dts long")
    assert rows(series.delta_classes(p, "k", "seq", "dts"), "seq", "kind") == [(0, None), (1, "forward"), (3, "duplicate"), (4, "backward"), (5, "forward"), (6, "wrap")]
    assert rows(series.adjacent_flags(p, "k", "seq", "dts").filter("delta = 0")) == []
    assert rows(series.longest_run(p, "k", "seq", F.col("dts").isNull())) == [("s", 1)]
    assert rows(series.rows_before(p, "k", "seq", F.col("dts") == 5)) == [("s", 4)] and rows(series.rows_before(p, "k", "seq", F.lit(False))) == [("s", 7)]
    g = spark.createDataFrame([("s", i, float(t)) for i, t in enumerate([0, 10, 20, 50])], "k string, seq int, t double")
    assert rows(series.gaps(g, "k", "seq", "t", F.lit(10.0))) == [("s", 1, 20.0, 20.0)]
    f = spark.createDataFrame([("s", 0, 1.0, True), ("s", 1, 0.5, False), ("s", 2, 3.0, True), ("s", 3, 4.0, False)], "k string, seq int, ts double, key boolean")
    assert rows(series.open_frames(f, "k", "seq", "ts", F.col("key"), ~F.col("key")), "seq", "open") == [(0, True), (2, False)]
    at = series.as_of(spark.createDataFrame([("s", 5), ("s", 0)], "k string, t int"), spark.createDataFrame([("s", 3, "a"), ("s", 5, "b"), ("s", 9, "c")], "k string, t int, v string"), "k", "t", "v")
    assert rows(at, "t", "matched") == [(0, None), (5, "b")]
    assert rows(series.band_pairs(spark.createDataFrame([(1, 0.0), (2, 16.0), (3, 33.0), (4, 16.0)], "i int, v double"), "i", "v", 16.0)) == [(1, 2), (1, 4), (2, 4)]


def test_resolution(spark):
    slugs = spark.createDataFrame([("red-tee",), ("blue-bag-530135",), ("long-coat",)], "slug string")
    images = spark.createDataFrame([("red-tee_800x.jpg",), ("products__red-tee__1.png",), ("KW5M5001_front.jpg",), ("530135-97-bag.jpg",), ("lomg-coat.jpg",), ("zzz.jpg",)], "image string")
    skus = spark.createDataFrame([("KW5M5001", "long-coat")], "sku string, slug string")
    got = dict((r["image"], (r["slug"], r["stage"])) for r in resolve.attribute_images(images, slugs, skus).collect())
    assert got["red-tee_800x.jpg"] == ("red-tee", "exact") and got["KW5M5001_front.jpg"] == ("long-coat", "sku") and got["530135-97-bag.jpg"] == ("blue-bag-530135", "tokens") and got["lomg-coat.jpg"] == ("long-coat", "ratio") and "zzz.jpg" not in got
    d = resolve.longest_prefix(spark.createDataFrame([("a_com_x",), ("zz",)], "name string"), spark.createDataFrame([("a",), ("a_com",)], "domain string"))
    assert rows(d) == [("a_com_x", "a_com")]


def test_candidates(spark):
    c = spark.createDataFrame([("k", 0, "png", 2000, "p", "a"), ("k", 1, "jpg", 8000, "j", "a"), ("l", 0, "png", 2000, "p", "a"), ("l", 1, "png-indexed", 90000, "i", "a"), ("m", 0, "png", 1023, "p", "a"), ("m", 1, "xyz", 5000, "x", "a"), ("n", 0, "webp", 0, "w", "a")], "asset string, ordinal int, fmt string, size long, url string, source string")
    assert rows(catalog.select_best(c, "asset"), "asset", "url") == [("k", "j"), ("l", "p"), ("n", "w")]
    f = spark.createDataFrame([("v", 0, "hd", "720p", "a"), ("v", 1, "hd", "1080p", "b"), ("v", 2, "source", "", "c")], "k string, ordinal int, quality string, rendition string, link string")
    assert rows(catalog.pick_rendition(f, "k")) == [("v", "c")] and rows(catalog.pick_rendition(f, "k", False)) == [("v", "b")]
    n = catalog.semantic_names(spark.createDataFrame([("g", "A-FRONT.png"), ("g", "b-front.PNG"), ("g", "x.jpg")], "g string, f string"), "g", "f")
    assert [r[1] for r in rows(n, "f", "new_name")] == ["front.png", "detail.jpg", "front-2.png"] or {r[1] for r in rows(n, "f", "new_name")} == {"front.png", "front-2.png", "detail.jpg"}
    docs = spark.createDataFrame([("p", {"ebay": '["1","2"]'}), ("q", {"ebay": "2"})], "slug string, c map<string,string>")
    assert rows(catalog.shared_values(catalog.exploded_citations(docs, "slug", "c"), "slug", "key", "value"), "value", "owners") == [("2", ["p", "q"])]
    e = catalog.evidence(spark.createDataFrame([("h", "cdx"), ("h", "wild"), ("i", "wild")], "host string, evidence string"))
    assert rows(e, "host", "trusted") == [("h", True), ("i", False)]


def test_stem_rules(spark):
    cols = "g string, filename string, sample_rate int, bit_depth int, is_lossy boolean, channels int, duration_samples long, true_peak_dbtp double, dc_offset_max double, fully_silent boolean, silent_channels array<int>, bit_depth_source string, sample_fmt string, time_reference long, pan double, classification string"
    s = spark.createDataFrame([("a", "x.wav", 48000, 24, False, 1, 100, 0.5, 0.0, False, [], "wav", "s32", 0, None, "drums"), ("a", "y.wav", 96000, 32, False, 2, 90, -1.0, 0.01, False, [1], "ffprobe_sample_fmt", "s32", 5, None, "vocal"), ("b", "z.mp3", 48000, 0, True, 2, 10, None, None, True, [0, 1], "x", "fltp", None, None, "other")], cols)
    assert rows(groups.output_format(s, "g"), "g", "rate", "depth", "dither_required") == [("a", 96000, 24, False), ("b", 44100, 16, True)]
    codes = {(r["g"], r["code"]) for r in groups.stem_flags(s, "g").collect()}
    assert codes == {("a", "input_clipping"), ("a", "dc_offset"), ("a", "dead_channel"), ("a", "length_drift"), ("a", "bit_depth_uncertain"), ("a", "rate_mismatch"), ("a", "depth_mismatch"), ("a", "stems_unanchored"), ("a", "pan_law_default_assumed"), ("b", "lossy_input"), ("b", "silent_file")}
    f = spark.createDataFrame([("src/a.css", "ELA_001", 10), ("src/a.css", "ELA_001", 20), ("b.css", "ELA_002", 1)], "file string, axiom string, line int")
    esc = readers.escape_table(spark.createDataFrame([("| e1 | `src/*` | ELA_001 | 9-11 | 2030-01-01 | why |",), ("| e2 | b.css | ELA_002 | - | 2020-01-01 | why |",), ("| e3 | b.css | ELA_002 | - | 2020-13-01 | why |",)], "value string"))
    assert rows(groups.escaped(f, esc, "2024-01-01"), "line", "status") == [(1, "expired"), (10, "suppressed"), (20, None)]


def test_sources_and_sinks(spark, tmp_path):
    import gzip
    import json

    (tmp_path / "f.jsonl").write_text('{"original_url":"u","success":true,"size":3}\nbroken\n')
    assert rows(readers.json_lines(spark, str(tmp_path / "f.jsonl")), "original_url", "size") == [("u", 3)]
    (tmp_path / "e.json").write_text(json.dumps([["urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length"], ["k", "1", "o", "m", "200", "d", "1"], ["k", "2", "o", "m", "200", "d", "1"]]))
    assert readers.extended_captures(spark, str(tmp_path / "e.json")).count() == 1
    for level, name in (("era", "p"), ("_skip", "q")):
        (tmp_path / "docs" / level / name).mkdir(parents=True)
        (tmp_path / "docs" / level / name / "canonical.json").write_text('{"slug": "%s"}' % name)
    assert rows(readers.product_documents(spark, str(tmp_path / "docs"), "slug string"), "slug", "level", "product") == [("p", "era", "p")]
    w = tmp_path / "w"
    w.mkdir()
    (w / "r.gz").write_bytes(gzip.compress(b"WARC/1.0\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody"))
    (w / "bad.gz").write_bytes(b"no")
    files = spark.read.format("binaryFile").load(str(w))
    assert [(r["http_header"], r["body"] and bytes(r["body"])) for r in readers.record_bodies(files).orderBy("path").collect()] == [(None, None), ("HTTP/1.1 200 OK", b"body")]
    (tmp_path / "page-0.json").write_text(json.dumps([["timestamp", "original", "s", "m"], ["2019", "u", "200", "t"], ["2021", "v", "200", "t"]]))
    pages = tmp_path / "pages"
    pages.mkdir()
    (tmp_path / "page-0.json").rename(pages / "page-0.json")
    (pages / "page-1.txt").write_text("2022 w 200 t more\nno digits 200 t\n2023 short\n")
    (pages / "page-2.json").write_text("")
    (pages / "page-3.json").write_text('{"error": 1}')
    assert rows(readers.paged_captures(spark, str(pages), **{"from": "2020"}), "original") == [("v",), ("w",)]
    pushed = readers.paged_captures(spark, str(pages)).filter("timestamp >= '2020' and timestamp <= '2021'")
    assert rows(pushed, "original") == [("v",)] and rows(readers.paged_captures(spark, str(pages), to="2021").filter("timestamp >= '2020'"), "original") == [("v",)]
    frames = readers.sniffed_frames(spark.createDataFrame([("1,I,0.5",), ("2.0,0,P",)], "value string"))
    assert rows(frames) == [(0.5, "I", 1), (2.0, "P", 0)]
    text = spark.createDataFrame([("f", 0, "pre"), ("f", 1, "TRACKS:"), ("f", 2, "a")], "path string, n int, value string")
    assert rows(readers.sections(text, "n"), "value", "section") == [("a", "TRACKS"), ("pre", None)]
    (tmp_path / "p.csv").write_text("0,N/A,5,1,K\n0,7,6,1,_\n")
    assert rows(readers.packets(spark, str(tmp_path / "p.csv")), "pts", "dts") == [(7, 6), (None, 5)]
    links = writers.merged_links(spark.createDataFrame([("k", "b")], "k string, l string"), spark.createDataFrame([("k", "a"), ("k", "b")], "k string, l string"), "k", "l")
    assert rows(links) == [("k", ["a", "b"])]
    writers.write_per_key(links, "k", str(tmp_path / "links"))
    assert "| a | b |" in writers.markdown(spark.createDataFrame([("a", "b")], "x string, y string"))
    try:
        writers.guarded("/truth/x", ("/truth",))
        raise AssertionError
    except PermissionError:
        pass


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("d", i, i >= 12) for i in range(13)], "d string, i int, ok boolean").orderBy("ok", F.desc("i")).coalesce(1).write.parquet(src)
    s = stateful.read_stream(spark, src, spark.read.parquet(src))
    stateful.drain_batches(stateful.breaker(s, "d", "ok", ["i"]), lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "cp"))
    assert rows(spark.read.parquet(out), "failures", "state") == [(0, "TRIPPED")]
    first = str(tmp_path / "first")
    stateful.drain(stateful.first_seen(stateful.read_stream(spark, src, spark.read.parquet(src)), ["d"]), first, str(tmp_path / "cp2"))
    assert spark.read.parquet(first).count() == 1
    stateful.drain(stateful.first_seen(stateful.read_stream(spark, src, spark.read.parquet(src)), ["d"]), first, str(tmp_path / "cp2"))
    assert spark.read.parquet(first).count() == 1


def test_full_text(spark):
    d = spark.createDataFrame([(1, "red rug red"), (2, "red mug"), (3, None), (4, "rug on a red and a blue floor")], "id int, t string")
    got = catalog.full_text(d, "id", "t", ["red", "rug"]).orderBy(F.desc("score"))
    assert [r["id"] for r in got.collect()] == [1, 4]


# ---- matching, against serial loops
NAMES = st.sampled_from(["adidas-Red Tee", "red tee", "tee", "Red", "mug", "", None, "t", "red-tee-2", "blue mug"])
COLORS = st.sampled_from([None, "", "Red", "blue", "!!", "navy"])
SLUGS = st.sampled_from(["red-tee", "adidas-red-tee", "red-tee-1", "red-tee-2019", "tee", "t", "blue-mug-red", "mug", "navy-mug", "adidas-", "", None, "blue-red-tee-navy"])


def serial_matches(slugs, skus):
    fold = lambda x: re.sub("^adidas-", "", re.sub("[^a-z0-9]+", "-", (x or "").strip().lower()).strip("-"))
    tail = lambda k: re.sub("-kids?$", "", re.sub("-infants?$", "", re.sub("-adults?$", "", k)))
    keys, taken, out = {}, set(), {}
    for g in dict.fromkeys(x for x in slugs if x):
        keys[re.sub(r"-\d$", "", re.sub(r"-\d{4}$", "", re.sub("^adidas-", "", g.lower())))] = g
    for sku, name, color in sorted(skus):
        api, n, c = tail(fold(" ".join(x for x in (name or "", color) if x or x == ""))), fold(name), fold(color)
        free = [(k, g) for k, g in keys.items() if g not in taken]
        hit = (keys[api], 1) if api in keys else next(((g, 2) for k, g in free if api and k and (api in k or k in api)), None) or next(((g, 3) for k, g in free if n and color and n in k and c in k), None)
        if hit:
            out[hit[0]] = (sku, hit[1])
            taken.add(hit[0])
    return {(g, *v) for g, v in out.items()}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(SLUGS, max_size=12), st.lists(st.tuples(NAMES, COLORS), max_size=12))
def test_products_match_as_in_a_serial_loop(spark, slugs, products):
    skus = [(f"s{i:02d}", n, c) for i, (n, c) in enumerate(products)]
    a = spark.createDataFrame(list(zip(slugs, range(99))), "slug string, ordinal int")
    b = spark.createDataFrame(skus, "sku string, name string, color string")
    assert {tuple(r) for r in resolve.match_products(a, b).collect()} == serial_matches(slugs, skus)


def test_serial_choice(spark):
    def serial(pairs):
        taken, out = set(), set()
        for by in sorted({p[0] for p in pairs}):
            if free := sorted((r, o) for b, o, r in pairs if b == by and o not in taken):
                taken.add(free[0][1])
                out.add((free[0][1], by))
        return out

    rng = random.Random(2)
    chain = [("s1", "A", 1), ("s2", "A", 1), ("s2", "B", 2), ("s3", "B", 1)]
    for pairs in (chain, [], *([(f"s{rng.randint(0, 9)}", rng.choice("ABCDEFGH"), rng.randint(0, 3)) for _ in range(30)] for _ in range(3))):
        df = spark.createDataFrame(pairs, "sku string, slug string, rank int")
        assert {tuple(r) for r in resolve.serial_choice(df, "sku", "slug", "rank").collect()} == serial(pairs)
    assert {tuple(r) for r in resolve.serial_choice(spark.createDataFrame(chain, "sku string, slug string, rank int"), "sku", "slug", "rank").collect()} == {("A", "s1"), ("B", "s2")}


def test_serial_choice_costs_no_job_a_link(spark, monkeypatch):
    """Many that all want one list took a round each, whose plans the driver kept."""
    written, write = [], resolve.materialize
    monkeypatch.setattr(resolve, "materialize", lambda d: written.append(d.columns) or write(d))
    n, chain = 25, "sku string, slug string, rank int"
    df = spark.createDataFrame([(f"s{i:02d}", f"g{j:02d}", j) for i in range(n) for j in range(n)], chain)
    want = {(f"g{i:02d}", f"s{i:02d}") for i in range(n)}
    assert {tuple(r) for r in resolve.serial_choice(df, "sku", "slug", "rank").collect()} == want and len(written) == 2
    monkeypatch.setattr(resolve, "ALONE", 100)
    assert {tuple(r) for r in resolve.serial_choice(df.unionByName(df), "sku", "slug", "rank").collect()} == want and len(written) == 4 + resolve.ROUNDS


def test_matching_stages_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["brand", "brand", "tee", "canyon", "anchor", "mug", "x", "530135", "ab", "olive", "navy", "rusty"])
    left = [(i, "-".join(["brand"] * (i % 3 > 0) + [word() for _ in range(rng.randint(1, 4))])) for i in range(60)] + [(90, None), (91, ""), (92, "--"), (93, "ab"), (94, "-".join(f"t{k}" for k in range(9)) + "-canyon")]
    right = [(i, "-".join(["brand"] + [word() for _ in range(rng.randint(1, 5))])) for i in range(60)] + [(90, None), (91, ""), (92, "b"), (94, "-".join(f"t{k}" for k in range(9)) + "-" + "-".join(f"u{k}" for k in range(40)) + "-canyon")]
    a, b = spark.createDataFrame(left, "id int, key string"), spark.createDataFrame(right, "id int, key string")
    some = lambda x, y: x and y and (x in y or y in x)
    assert {tuple(r) for r in resolve.contained(a, b).collect()} == {(i, j) for i, x in left for j, y in right if some(x, y)}
    tokens = lambda k: set(re.findall("[a-z0-9]+", (k or "").lower()))
    want = {}
    for i, x in left:
        for j, y in right:
            both = tokens(x) & tokens(y)
            score = len(both) / max(1, len(tokens(x) | tokens(y)))
            if both and (max(map(len, both)) >= 5 or score >= 0.6):
                want[i] = min(want.get(i, (0, 0)), (-score, j))
    assert {r["lid"]: (r["rid"], r["score"]) for r in resolve.token_matches(a, b).collect()} == {i: (j, round(-sc, 6)) for i, (sc, j) in want.items()}
    near = [(i, "".join(c if rng.random() > 0.08 else rng.choice("abc") for c in k)) for i, k in left if k] + [(95, None), (96, ""), (97, "a")]
    ratio = lambda x, y: difflib.SequenceMatcher(None, y, x).ratio()
    want = {i: max((ratio(x, y), j) for j, y in right if y) for i, x in near if x}
    got = {r["lid"]: (r["ratio"], r["rid"]) for r in resolve.close_matches(spark.createDataFrame(near, "id int, key string"), b).collect()}
    assert got == {i: (round(q, 6), j) for i, (q, j) in want.items() if q >= 0.85} and len(got) > 10


def test_containment_meets_by_rare_marks(spark):
    """Every three letters are frequent here, so trigrams would pair each key with most texts; marks of longer keys are few and rare."""
    rng = random.Random(5)
    texts = ["-".join(rng.choice(["lor", "mel", "sel", "vor"]) + rng.choice(["lor", "mel", "sel", "vor"]) for _ in range(5)) for _ in range(300)]
    keys = sorted({t[i : i + n] for t in texts[:60] for n in (1, 2, 3, 5, 6, 11, 12, 13, 20, 34) for i in [rng.randint(0, len(t) - n)]} | {"zz", "lorx", "lormel-lormelx", "lorlor-lorlor-lorlor"})
    k, t = spark.createDataFrame([(x,) for x in keys], "key string"), spark.createDataFrame([(x,) for x in [*texts, "", None]], "key string")
    assert {tuple(r) for r in resolve.inside(k, t).collect()} == {(x, y) for x in keys for y in texts if x in y}
    q, w = resolve.TIERS[-1]
    own = {r["key"]: r["m"] for r in k.unionByName(t).filter("key is not null").select("key", resolve.marks(F.col("key"), q, w).alias("m")).collect()}
    for x in keys:
        assert (own[x] is None) == (len(x) < q + w - 1)
        assert all(set(own[x]) <= set(own[y]) for y in texts if own[x] and x in y)
    assert sum(len(own[y]) for y in texts) < 300 * 34 / 2
    whole = [x for x in keys if len(x) == 34]
    pairs = sum(min(sum(m in own[y] for y in texts) for m in own[x]) for x in whole)
    assert len(whole) > 20 and 3 * pairs < sum(min(sum(x[i : i + 3] in y for y in texts) for i in range(32)) for x in whole)


def test_token_matches_by_sets(spark):
    """One row a set of tokens instead of pairs of rows; keys of many tokens, with and without a strong one, too."""
    rng = random.Random(6)
    words = ["hooded", "parka", "black", "cap", "tee", "x1", "x2", "x3", *(f"w{i}" for i in range(14))]
    key = lambda n: " ".join(rng.sample(words, n))
    left = [(i, key(rng.choice([2, 4, 6, 13, 16, 20]))) for i in range(40)] + [(80, " ".join(f"w{i}" for i in range(14)))]
    right = [(f"r{i:02d}", key(rng.choice([2, 3, 5, 7, 14, 18]))) for i in range(60)] + [("r90", " ".join(f"w{i}" for i in range(13)) + " q")]
    want = {}
    for i, x in left:
        for j, y in right:
            a, b = set(x.split()), set(y.split())
            score = len(a & b) / len(a | b)
            if a & b and (max(map(len, a & b)) >= 5 or score >= 0.6):
                want[i] = min(want.get(i, (0, "")), (-score, j))
    got = resolve.token_matches(spark.createDataFrame(left, "id int, key string"), spark.createDataFrame(right, "id string, key string"))
    assert {r["lid"]: (r["rid"], r["score"]) for r in got.collect()} == {i: (j, round(-sc, 6)) for i, (sc, j) in want.items()}
    sets = lambda *t: {tuple(s) for s in spark.range(1).select(F.explode(resolve._sets(F.array(*map(F.lit, t))))).select("col.*").collect()}
    assert len(sets("a", "b", "c")) == 8 and sets("a", "b", "c") & sets("b", "c", "d") == sets("b", "c")
    assert len(sets(*(f"{i:02d}" for i in range(13)))) == 1 + 13 + 78 + 286


def test_token_matches_broadcast_no_sets(spark, monkeypatch):
    """Files of keys are small, the sets exploded from them are not: broadcast by the files' size they filled the driver."""
    plans, write = [], resolve.materialize
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(resolve, "materialize", lambda d: plans.append(plan(d)) or write(d))
    long = " ".join(f"w{i}" for i in range(14))
    left = spark.createDataFrame([(1, "hooded parka black"), (2, f"{long} q")], "id int, key string")
    right = spark.createDataFrame([("a", "parka"), ("b", long)], "id string, key string")
    for most, sent in ((resolve.SENT, 2), (0, 0)):  # only the tokens, once a side, and not many of them
        monkeypatch.setattr(resolve, "SENT", most)
        plans.clear()
        top = resolve.token_matches(left, right)
        assert {tuple(r) for r in top.collect()} == {(1, "a", round(1 / 3, 6)), (2, "b", round(14 / 15, 6))}
        plans.append(plan(top))
        assert sum("SortMergeJoin" in p for p in plans) > 1 and sum("Broadcast" in p for p in plans) == sent and "Broadcast" not in plans[-1]


def test_cascade_computes_stems_once(spark, monkeypatch):
    """The stem is a long expression; inlined into all stages it was planned and computed again for each."""
    written, write = [], resolve.materialize
    monkeypatch.setattr(resolve, "materialize", lambda d: written.append(d.columns) or write(d))
    images = spark.createDataFrame([("https://a.com/i/blue-cap.jpg?x=1",), ("shop__red-mug.png",), ("",), ("blue-ca_1.jpg",)], "image string")
    slugs = spark.createDataFrame([("blue-cap",), ("red-mug",)], "slug string")
    got = resolve.attribute_images(images, slugs, fuzzy=False)
    assert rows(got, "image", "slug", "stage") == sorted([("https://a.com/i/blue-cap.jpg?x=1", "blue-cap", "exact"), ("shop__red-mug.png", "red-mug", "parts")], key=str)
    assert written[0] == ["image", "stem"]


def test_cascade_skips_what_has_nothing_to_do(spark, monkeypatch):
    """Stages without hits rewrote all images, and grams were made of each slug even if no key left was near its length."""
    written, write = [], resolve.materialize
    monkeypatch.setattr(resolve, "materialize", lambda d: written.append(d.columns) or write(d))
    slugs = [("blue-cap",), ("red-mug",), ("mossy-anchor",), ("\u00e9t\u00e9-" + "long-" * 9,)]
    images = [("a__red-mug.png",), ("red-mug__z.png",), ("red-mug__blue-cap.png",), ("red-mug.jpg",), ("anchor-mossy_1.jpg",), ("mossy-anchro.jpg",)]
    got = resolve.attribute_images(spark.createDataFrame(images, "image string"), spark.createDataFrame(slugs, "slug string"))
    want = [("a__red-mug.png", "red-mug", "parts"), ("red-mug__z.png", "red-mug", "parts"), ("red-mug__blue-cap.png", "blue-cap", "parts"), ("red-mug.jpg", "red-mug", "exact"), ("anchor-mossy_1.jpg", "mossy-anchor", "tokens"), ("mossy-anchro.jpg", "mossy-anchor", "tokens")]
    assert rows(got, "image", "slug", "stage") == sorted(want, key=str)
    assert sum("stem" in c for c in written) == 3 and not any("gkr" in c for c in written)
    kept = []
    monkeypatch.setattr(resolve, "materialize", lambda d: (lambda w: kept.append((d.columns, w.count())) or w)(write(d)))
    near = resolve.close_matches(spark.createDataFrame([(1, "mosy-anchor")], "id int, key string"), spark.createDataFrame([(i, k) for i, (k,) in enumerate(slugs)], "id int, key string"))
    assert [(r["lid"], r["rid"]) for r in near.collect()] == [(1, 2)] and {c[0]: n for c, n in kept}["kr"] == 1


def test_containment_of_bytes_and_of_many_short_keys(spark, monkeypatch):
    texts = ["caf\u00e9-noir", "\u00e9t\u00e9 blanc", "na\u00efve \U0001f600 hat", "hat", "a", "", "x" * 40, "xx\u00e9" * 9]
    keys = ["\u00e9", "\u00e9-", "t\u00e9", "\U0001f600", "hat", "a", "xxxxxxxxxxxx", "x\u00e9xx\u00e9xx\u00e9x", "\u00e8", ""]
    k, t = spark.createDataFrame([(x,) for x in [*keys, None]], "key string"), spark.createDataFrame([(x,) for x in [*texts, None]], "key string")
    want = sorted((x, y) for x in keys for y in texts if x and x in y)
    assert sorted(map(tuple, resolve.inside(k, t).collect())) == want
    monkeypatch.setattr(resolve, "FEW", 0)
    assert sorted(map(tuple, resolve.inside(k, t).collect())) == want


def test_replaced_table_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.replace_table(spark.range(2), path)
    writers.replace_table(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3 and {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"t"}
    (tmp_path / "t").rename(tmp_path / "t.old")  # as if the process had ended between the renames
    assert spark.read.parquet(writers.recovered(spark, path)).count() == 3
    writers.replace_table(spark.range(4), path)
    assert spark.read.parquet(path).count() == 4


def test_cached_import(spark):
    page = b'<link rel=canonical href="https://web.archive.org/web/2019/https://a.com/products/x">'
    f = spark.createDataFrame([("p.html", page), ("www.A.com_collections_y.html", b""), ("b.org_z.html", None), ("none.html", b"x"), ("a.com_old.html", b"12345"), (None, page)], "name string, content binary")
    d = spark.createDataFrame([("a.com",), ("www.a.com",), ("B.org",)], "domain string")
    have = spark.createDataFrame([("a.com_old.html", 5), ("a.com_products_x.html", 3)], "name string, size int")
    got = rows(readers.cached_import(f, d, have), "name", "original_url", "tier", "size", "found_by")
    assert got == sorted([("p.html", "https://a.com/products/x", "html", len(page), "canonical"), (None, "https://a.com/products/x", "html", len(page), "canonical"), ("www.A.com_collections_y.html", "https://www.a.com/collections/y", "collection", 0, "filename"), ("b.org_z.html", "https://B.org/z", "homepage", 0, "filename")], key=str)
