"""Operators whose results SQL or a few lines of Python repeat: mixing, decontamination, URL rules, WARC, shards."""

import math
import struct
import zlib

import pytest
import xxhash

from lexiscreen.llm import decontaminate, mix, shard, url_filter, warc

from .conftest import EDGES, rows


@pytest.mark.parametrize("clashes", [False, True])
def test_mix_agrees_with_sorting(spark, tables, sql, clashes):
    many = [(k, "word " * (k % 7 + 1), "en", f"s{k % 5}" if k % 3 else "s0", 1) for k in range(10, 400)]
    folder = tables(clashes, documents=EDGES + many)
    assert rows(mix.op1(spark, folder)) == sql(mix.OP1_SQL, folder)


def test_mix_reaches_targets(spark, folder):
    got = mix.op1(spark, folder).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    by = got.assign(source=spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source").toPandas().set_index("doc_id").loc[got.doc_id].source.values).groupby("source")
    assert abs(by.taken.sum() - by.target.first()).max() <= got["size"].max()
    assert abs(by.target.first().sum() - 1.5 * got["size"].sum()) < 1e-6


def test_remix_repeats_rows(spark, tables):
    docs = [(k, "a b c", "en", "x" if k < 90 else "y", 5) for k in range(100)]
    got = mix.remix(spark.read.parquet(tables(True, documents=docs) + "/documents.parquet"))
    assert "mix_cut" in got.columns and got.select("source").groupBy("source").count().collect()
    count = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert count["y"] == 20 and abs(count["x"] - 130) <= 1


@pytest.mark.parametrize("clashes", [False, True])
def test_decontamination_agrees_with_sql(spark, tables, sql, clashes):
    items = [(1, "alpha beta gamma delta"), (2, " ".join(f"w{i}" for i in range(25))), (3, None), (4, ""), (5, "Alpha BETA, gamma; delta!"), (None, "x1 x2 x3")]
    docs = [
        (20, "see ALPHA-beta.gamma/delta and alpha beta gamma delta", "en", "s", 1),
        (21, "begin " + " ".join(f"w{i}" for i in range(3, 20)) + " end", "en", "s", 1),
        (22, "alpha beta gamma deltas", "en", "s", 1),
        (23, "x1 x2 x3 " * 500, "en", "s", 1),
        (24, " ".join(f"w{i}" for i in range(9)), "en", "s", 1),
    ]
    short = [d for d in EDGES if d[0] != 6]  # SQL carries the word list to every position
    folder = tables(clashes, documents=short + docs, benchmark=items)
    want = sql(decontaminate.OP4_SQL, folder)
    got = rows(decontaminate.op4(spark, folder))
    # SQL's join leaves the item without id out of its list; its id counts as empty text here.
    assert [g for g in got if g[1] != 23] == [w for w in want if w[1] != 23]


def test_decontamination_offsets_and_slices(spark, tables):
    items = [(k, f"é{k} b{k} c{k}") for k in range(40)]
    docs = spark.createDataFrame([(1, "ÀÉ  é7--b7 c7? then é9 b9 c9")], "id int, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    whole = decontaminate.contamination(docs, bench, "f").first()["f"]
    text = "ÀÉ  é7--b7 c7? then é9 b9 c9"
    assert [text[s["start"] : s["end"]] for s in whole["spans"]] == ["é7--b7 c7", "é9 b9 c9"]
    long = decontaminate.contamination(docs.selectExpr("id", "repeat('filler words ', 100000) || text AS text"), bench, "f").first()["f"]
    assert (long["n_words"], long["n_hit"], long["items"]) == (200_008, 6, ["7", "9"])
    parts = decontaminate.slices(bench, 100)
    assert len(parts) > 3 and sum(map(len, parts)) == 40
    found = None
    for part in parts:
        auto = decontaminate._build(part, 10)
        ids = decontaminate.search(auto, text.encode())[1]
        found = (found or set()) | ids
    assert found == set(whole["items"]) == {"7", "9"}


def test_urls_agree_with_sql(spark, tables, sql):
    urls = [
        None, "", "example.org/es/", "http://", "http://example.org", "http://Example.ORG/es/x?y#z", "https://a.b.example.org/en/1066.html",
        "https://example.org/en/2", "https://notexample.org/es/", "x://com/fr/", "x://q.com/de/?", "x://com/de", "x://org?/es/", "x://org/#a",
        "a://b://org/fr/", "http://example.net/fr/1", "http://é.org/ü", "http://a..org/x", "http://org./x", "line\nbreak://org/\n",
    ]
    folder = tables(True, pages=[(k if k else None, u, "h") for k, u in enumerate(urls)] + [(3, "http://org/x", None)] * 2)
    assert rows(url_filter.op6(spark, folder)) == sql(url_filter.OP6_SQL, folder)
    assert url_filter.op6(spark, tables()).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("concat('key', id) AS key")
    listed = spark.range(0, 20_000, 37).selectExpr("concat('key', id) AS key")
    levels = url_filter.cascade(listed, universe)
    assert len(levels) > 1
    got = universe.filter(url_filter.member(universe["key"], levels))
    assert got.exceptAll(listed).isEmpty() and listed.exceptAll(got).isEmpty()


def test_rules_too_long_for_constants(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.b.org/x/y"), (2, "http://b.org/"), (2, "http://b.org/"), (3, None)], "page_id int, url string")
    rules = spark.createDataFrame([("allow", "org", "/"), ("block", "b.org", "/x"), ("allow", "b.org", "/x")], "verdict string, host string, path string")
    want = rows(url_filter.judge(pages, rules))
    monkeypatch.setattr(url_filter, "MOST_BITS", 8)
    assert rows(url_filter.judge(pages, rules)) == want
    assert ("a.b.org", 1, "/x/y", "b.org/x", "block") in want


def test_warc_agrees_with_sql(spark, tables, sql):
    big = "<p>Größe</p>" * 200
    pages = [(1, "http://a/", big), (2, "http://b/%41\r\nX: y", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "http://c/", "x" * 3_000_000)]
    folder = tables(True, pages=pages + [(None, "n", big), (3, None, big), (9, "w", "WARC/1.1\r\n\r\n" * 300)])
    assert rows(warc.op7(spark, folder)) == sql(warc.OP7_SQL, folder)
    assert warc.op7(spark, tables()).count() == 0


def test_warc_filters_and_foreign_files(spark, tables, tmp_path):
    warc.register(spark)
    folder = tables(pages=[(1, "http://a/%\x01", "p" * 2000), (2, "http://b/", "p" * 2000)])
    path = str(tmp_path / "w")
    warc.records(spark.read.parquet(folder + "/pages.parquet")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    assert [r.target_uri for r in back.filter("record_type = 'revisit'").collect()] == ["http://a/%\x01"]
    assert back.filter("record_type IN ('response')").select("payload").first()[0] == b"p" * 2000
    headers = spark.read.format("warc").option("payload", "false").load(path)
    assert headers.filter("payload IS NOT NULL").count() == 0 and headers.count() == 2
    import gzip

    other = tmp_path / "other"
    other.mkdir()
    record = lambda n, body: f"WARC/1.0\r\nWARC-Type: {n}\r\nWARC-Target-URI: u:{n}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    (other / "a.warc").write_bytes(record("warcinfo", "i") + record("response", "x" * 40_000) + record("request", ""))
    (other / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(n, b)) for n, b in (("response", "y" * 50_000), ("metadata", "m"))))
    got = spark.read.format("warc").load(str(other))
    assert sorted((r.record_type, r.payload_bytes, bytes(r.payload)[:1]) for r in got.collect()) == [
        ("metadata", 1, b"m"), ("request", 0, b""), ("response", 40000, b"x"), ("response", 50000, b"y"), ("warcinfo", 1, b"i"),
    ]
    assert got.filter("record_type = 'metadata'").count() == 1


def test_warc_headers_as_written(spark, tmp_path):
    """Whatever stands in a header of a foreign file is read as it is, and nothing there stops the job."""
    odd = ["http://x/50%off", "http://x/100%", "http://x/a%20b", "http://x/%zz%41", "caf\xe9"]
    lines = [f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {u}\r\nContent-Length: 1\r\n\r\nz\r\n\r\n".encode("latin-1") for u in odd]
    lines.append(b"WARC/1.0\r\nWARC-Type: folded\r\nno header\r\n: none\r\nWARC-Target-URI: http://x/\r\n  more\r\nContent-Length: 2\r\nWARC-Payload-Length: many\r\n\r\nab\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(b"".join(lines))
    import gzip

    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"WARC/1.0\r\nWARC-Type: endless\r\nContent-Length: lots\r\n\r\nabc\r\n\r\n"))
    warc.register(spark)
    got = {(r.record_type, r.target_uri): r.payload_bytes for r in spark.read.format("warc").load(str(tmp_path)).collect()}
    assert {u for t, u in got if t == "response"} == {*odd[:4], "caf\ufffd"}
    assert got["folded", "http://x/ more"] == 2 and got["endless", None] == 7


@pytest.mark.parametrize("value", ["http://x/50%off", "http://b/%41", "a\r\nX: y", " both ends  ", "tab\there %0A", "", "é\x7f", "  "])
def test_warc_headers_round_trip(value):
    import zlib

    record = {"record_id": "r", "record_type": "revisit", "target_uri": value, "payload_digest": "0" * 40}
    data = zlib.decompress(warc.encode(record), 31)
    head = data.split(b"\r\n\r\n")[0]
    headers = warc.parse_headers(head)
    assert headers["warc-target-uri"] == value and headers["warc-date"].endswith("Z") and "warc-profile" in headers
    assert headers["warc-payload-digest"] == "sha1:" + "0" * 40
    assert (b"X-Encoded" in head) == (value not in ("http://x/50%off", "http://b/%41", ""))


def _shard(key, n):
    def value(s):
        h = xxhash.xxh64_intdigest(struct.pack("<i", s), seed=xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42) if key is not None else 42)
        return -math.log(((h >> 11) + 0.5) / (1 << 53))

    return min(range(n), key=value)


def test_shards_agree_with_brute_force(spark, tables):
    docs = EDGES + [(k, "t" * (k % 5), "en", "s", 1) for k in range(-200, 400)]
    got = shard.op9(spark, tables(True, documents=docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.shard, r.grown_shard) == (_shard(r.doc_id, 40), _shard(r.doc_id, 41))
    assert {r.grown_shard for r in got if r.grown_shard != r.shard} == {40}
    want = sorted((str(d[0]), len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    for s in range(40):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert shard.op9(spark, tables()).count() == 0


def test_weighted_shards(spark):
    from pyspark.sql import functions as F

    got = spark.range(20_000).groupBy(shard.rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).count().collect()
    assert abs({r["s"]: r["count"] for r in got}[1] - 15_000) < 300
