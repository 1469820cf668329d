import os

import pytest
from pyspark.sql import functions as F

from lexiscreen.operators import configs, edits, guardrail, ranking
from lexiscreen.packs import rules as packs
from lexiscreen.plans import check, review
from lexiscreen.sources import conllu, lexicon, markup
from lexiscreen.streaming import jobs


def test_greedy_selection_against_brute_force(spark):
    spans = [(0, 3), (1, 2), (2, 6), (3, 4), (5, 9), (6, 7), (9, 10), (10, 14), (11, 12), (13, 15), (14, 16)]
    df = spark.createDataFrame([(d, i, s) for d in (1, 2) for i, s in spans[d - 1 :]], "doc_id long, i int, skip int")
    got = {(r.doc_id, r.i) for r in ranking.non_overlapping(df).collect()}
    want = set()
    for d in (1, 2):
        reach = 0
        for i, s in spans[d - 1 :]:
            if i >= reach:
                want.add((d, i))
                reach = s
    assert got == want


def test_findings_never_overlap_and_slice_to_their_text(spark, folder):
    from lexiscreen.sources import texts as src

    docs = src.documents(spark, folder)
    found = check.findings(docs, spark).select("doc_id", "start", "end", F.col("text").alias("t"))
    bad = docs.join(found, "doc_id").filter("substring(text, start + 1, end - start) <> t").count()
    a, b = found.alias("a"), found.alias("b")
    overlap = a.join(b, F.expr("a.doc_id = b.doc_id AND a.start < b.start AND b.start < a.end")).count()
    assert bad == 0 and overlap == 0


def test_suffix_name_and_phrase(spark):
    df = spark.createDataFrame([(1, "de", "Schönheit und die FreiHeit-Heit der die")], "doc_id long, lang string, text string")
    got = {(r.text, r.rule_id) for r in check.matched(df, packs.rules(spark), packs.lemmas(spark)).collect()}
    assert ("Schönheit", 26) in got and ("und die", 23) in got and ("die", 22) in got


def test_verdicts(spark):
    words = spark.createDataFrame([(1, 10), (2, 0), (3, 100)], "doc_id long, words int")
    counts = spark.createDataFrame([(1, "overall", 1), (2, "overall", 1), (3, "basic", 9)], "doc_id long, level string, found long")
    by_ratio = review.limits(spark, [("overall", None, 0.1, 0), ("basic", 9, 0.5, 3)])
    got = {r.doc_id: r.failed_on for r in guardrail.verdicts(words, counts, by_ratio).collect()}
    assert got == {1: "overall", 2: None, 3: "basic"}


def test_edit_script_replays(spark):
    rows = [(1, "a b c d", "a x c"), (2, "", "new words"), (3, "same", "same")]
    got = edits.word_edits(spark.createDataFrame(rows, "doc_id long, before string, after string")).collect()
    for key, before, after in rows:
        ops = sorted((r.ord, r.op, r.text) for r in got if r.doc_id == key)
        assert "".join(t for _, op, t in ops if op != "insert") == before
        assert "".join(t for _, op, t in ops if op != "delete") == after


def test_markup_keeps_length(spark):
    html = "<p>Hallo<br/> Welt</p><script>a<b</script> 1 < 2"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    text = markup.flatten(df).first().text
    assert len(text) == len(html) and "Hallo" in text and "a<b" not in text
    for r in markup.spans(df).collect():
        assert html[r.start] == "<" and text[r.start : r.end].strip() == ""


def test_conllu(spark, tmp_path):
    block = "# text = im Haus\n1-2\tim\t_\t_\n1\tin\tin\tADP\n2\tdem\tder\tDET\n2.1\t_\t_\t_\n3\tHaus\tHaus\tNOUN\n"
    path = tmp_path / "a.conllu"
    path.write_text(block + "\n" + block.replace("Haus", "Hof"))
    rows = conllu.read(spark, str(path)).orderBy("sentence", "n").collect()
    assert [(r.form, r.upos) for r in rows] == [("im", None), ("Haus", "NOUN"), ("im", None), ("Hof", "NOUN")]


def test_csv_taxonomy_and_pack(spark, tmp_path):
    (tmp_path / "a.csv").write_text("word,note\nGast,\nKind,x\n")
    assert [r.note for r in lexicon.load_csv(spark, str(tmp_path / "a.csv"), "word string, note string").collect()] == ["", "x"]
    (tmp_path / "c.json").write_text('{"a":{"category":"x"},"b":{"category":"x"}}')
    (tmp_path / "d.json").write_text('{"b":{"category":"y"}}')
    merged = lexicon.load_taxonomy(spark, str(tmp_path / "c.json"), str(tmp_path / "d.json"))
    assert {r.key: r.category for r in merged.collect()} == {"a": "x", "b": "y"}
    rules = packs.rules(spark).select("*", (F.col("rule_id") != 1).alias("is_active"), F.lit("").alias("notes"))
    lexicon.build(rules, packs.alternatives(spark), str(tmp_path / "pack"))
    loaded = lexicon.load_rules(spark, str(tmp_path / "pack" / "rules"))
    assert loaded.filter("rule_id = 1").count() == 0 and loaded.count() == len(packs.RULES) - 1
    assert lexicon.provenance(spark, str(tmp_path / "a.csv")).first().sha256


def test_flag_layers(spark):
    df = spark.range(1)
    record = lambda v, s: F.struct(F.lit(v).alias("value"), F.lit(s).alias("status"))
    settle = lambda request, user, org, may: df.select(
        configs.settle_flag(F.lit(request).cast("boolean"), F.lit(None).cast("boolean"), user, org, F.lit(True), may)
    ).first()[0]
    assert settle(True, record(False, "suggestion"), record(False, "suggestion"), True) is True
    assert settle(True, record(False, "suggestion"), record(False, "suggestion"), False) is False
    assert settle(True, record(False, "force"), record(True, "suggestion"), True) is False
    assert settle(True, record(False, "force"), record(True, "force"), True) is True


def test_minute_limit_with_a_hot_key(spark):
    rows = [(k, 1 if k % 3 else 2, f"2024-01-01 00:00:{k % 60:02d}") for k in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = jobs.admitted(df, limit=5)
    assert got.count() == 300
    per_user = {r.user_id: r.n for r in got.filter("admitted").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert per_user == {1: 5, 2: 5}


def test_registry_is_whole():
    import __spark_entry__ as contract

    names, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 150


@pytest.mark.parametrize("prefix", ["c01", "j0", "w0", "f1", "p0", "r0", "s0"])
def test_queries_agree_with_plain_sql(spark, folder, prefix):
    import duckdb

    import __spark_entry__ as contract
    from tests import check_queries as tool

    con = duckdb.connect()
    for t in tool.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    sql = contract.oracle_sql()
    for name, function in contract.queries().items():
        if name.startswith(prefix) and name in sql:
            text, _, _ = tool.compare(spark, con, folder, name, function, sql[name])
            assert text.startswith("ok"), (name, text)


def test_long_rules_and_contractions(spark):
    """A rule is cut like a text, and the neighbourhood is as long as the longest rule."""
    from lexiscreen.packs import literal, rules as packs
    from lexiscreen.plans import check

    said = ["don't stop", "one two three four five six seven eight nine ten eleven twelve", "well-known don't stop"]
    rows = [(900 + k, "en", s, "default", True, False, "", "culture", "default", None, False, None, None, None) for k, s in enumerate(said)]
    rules = literal.frame(spark, packs.RULE_COLUMNS, rows)
    texts = [(9_000_000_000_000_000_000 + k, "en", f"Please {s}, now.") for k, s in enumerate(said)]
    df = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    got = {(r.doc_id - 9_000_000_000_000_000_000, r.rule_id, r.text) for r in check.matched(df, rules, packs.lemmas(spark)).collect()}
    assert got == {(0, 900, said[0]), (1, 901, said[1]), (2, 902, said[2]), (2, 900, said[0])}


def test_review_takes_any_id(spark):
    from lexiscreen.plans import review

    df = spark.createDataFrame([(9_000_000_000_000_000_000, "en", "the cat and that. " * 200)], "doc_id long, lang string, text string")
    row = review.review(df, spark).first()
    assert row.doc_id == 9_000_000_000_000_000_000 and row.words == 800 and row.verdict == "fail"


def test_cluster_needs_a_shared_folder():
    import pytest

    from lexiscreen.session import checkpoint_dir

    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        checkpoint_dir(Session)


def test_language_rules(spark):
    from lexiscreen.operators import langid

    scores = [(1, "en", 0.5), (1, "de", 0.46), (1, "fr", 0.2), (2, "en", 0.28), (2, "de", 0.27), (3, "en", 0.9)]
    got = langid.best(spark.createDataFrame(scores, "doc_id int, lang string, score double"))
    assert sorted((r.doc_id, r.place, r.lang) for r in got.collect()) == [(1, 0, "en"), (1, 1, "de"), (2, 1, "de"), (3, 0, "en")]


def test_treebank_with_carriage_returns(spark, tmp_path):
    from lexiscreen.sources import conllu

    one = "# text = a b\r\n1\ta\ta\tNOUN\r\n2\tb\tb\tVERB\r\n\r\n"
    (tmp_path / "x.conllu").write_text(one * 3, newline="")
    got = conllu.read(spark, str(tmp_path / "x.conllu")).collect()
    assert len(got) == 6 and len({r.sent for r in got}) == 3


def test_ipv6_is_masked(spark):
    from pyspark.sql import functions as F

    from lexiscreen.functions import privacy

    df = spark.createDataFrame([("at 2001:db8::ff00:42:8329 or http://[fe80::1:2]:80/x, std::vector 12:30",)], "t string")
    assert df.select(privacy.mask(F.col("t"))).first()[0] == "at <URL> or <URL> std::vector <NUMBER>:<NUMBER>"


def test_issue_lists_are_json(spark):
    import json

    kind = "array<struct<ord:int,alt:string,is_remove:boolean,is_inspiration:boolean,label:string>>"
    rows = [(1, 0, 'say "x\\y"', [(1, 'a "b"', False, False, None), (2, None, True, False, None)], None), (1, 9, "z", [], 'why "not"'), (1, 12, "q", [], None)]
    df = spark.createDataFrame(rows, f"doc_id int, start int, text string, alternatives {kind}, explanation string")
    got = guardrail.quoted(df).first()
    assert got.changes == 1 and json.loads(got.issues) == [
        {"issue": 'say "x\\y"', "alternatives": [{"alt": 'a "b"'}, {"remove": True}]},
        {"issue": "z", "alternatives": [], "explanation": 'why "not"'},
    ]


def test_word_edits_cover_every_sentence(spark, tmp_path):
    from lexiscreen.catalog import QUERIES

    texts = [(1, "See localhost today."), (2, "Nothing to hide."), (3, "Call 123 now.")]
    rows = [(k, t, "en", "s", len(t)) for k, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.ord, r.op, r.text) for r in QUERIES["c08_word_edits"](spark, str(tmp_path)).collect())
    by = {k: [(op, text) for key, _, op, text in got if key.startswith(f"{k}-")] for k, _ in texts}
    assert by[1] == [("keep", "See "), ("delete", "localhost"), ("insert", "<URL>"), ("keep", " today.")]
    assert by[2] == [("keep", "Nothing to hide.")]
    assert ("insert", "<NUMBER>") in by[3]
