"""Reviews with offsets and languages of parts, notes that are replaced, and keyed state across batches of a stream."""

import json

from pyspark.sql import functions as F

from lexiscreen.catalog import streams
from lexiscreen.functions import words as w
from lexiscreen.operators import guardrail
from lexiscreen.packs import fixed
from lexiscreen.plans import review
from lexiscreen.streaming import jobs


def test_review_in_parts(spark):
    long = "😀😀 and then. " * 30 + "That is the end."
    texts = [(1, None, long), (2, "de", "Die Katze"), (3, None, "12 34"), (4, None, "the cat is here. " * 20 + "der Hund und die Katze. " * 20), (5, "es", "la casa"), (6, None, None)]
    rows = {r["doc_id"]: r for r in review.review(spark.createDataFrame(texts, "doc_id int, lang string, text string"), spark, 100).collect()}
    first = rows[1]
    assert (first["language"], first["verdict"], first["failed_on"]) == ("en", "fail", "overall")
    units = long.encode("utf-16-le")
    assert len(first["found"]) >= 3
    for f in first["found"]:
        assert units[2 * f["start16"] : 2 * f["end16"]].decode("utf-16-le") == f["text"]
    assert rows[1]["words"] == len(long.split())
    message = first["reask"]
    assert json.dumps(long, ensure_ascii=False) in message and message.startswith(fixed.REASK[:20])
    issues = json.loads(message[message.index("\n[") + 1 :])
    assert issues[0]["issue"] and issues[0]["alternatives"]
    assert (rows[2]["language"], rows[2]["verdict"]) == ("de", "fail")
    assert (rows[3]["language"], rows[3]["words"], rows[3]["verdict"], rows[3]["reask"]) == (None, 0, "pass", None)
    found = {f["text"].lower() for f in rows[4]["found"]}
    assert rows[4]["language"] == "en" and {"the", "und die"} <= found
    assert (rows[5]["language"], rows[5]["verdict"]) == (None, "pass") and rows[6]["verdict"] == "pass"


def test_language_by_frequent_words(spark):
    texts = {"the cat is here": "en", "der Hund und die Katze": "de", "le chat est là": "fr", "12": None, "die is the": "en", None: None}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["l"] for r in frame.select("t", w.stopword_language(F.col("t")).alias("l")).collect()} == texts


def test_only_the_own_note_is_taken_off(spark):
    mark = fixed.NOTE_MARK
    texts = [(1, f"an answer{mark}about 9"), (2, f"an answer{mark}something else"), (3, "an answer"), (4, f"a{mark}b{mark}about {len(f'a{mark}b')}"), (5, f"{mark}about 0")]
    frame = spark.createDataFrame(texts, "doc_id int, text string")
    about = lambda t: t.select("doc_id", F.concat(F.lit("about "), F.length("text").cast("string")).alias("note"))
    got = {r["doc_id"]: r["text"] for r in guardrail.without_note(frame, about).collect()}
    assert got == {1: "an answer", 2: texts[1][1], 3: "an answer", 4: f"a{mark}b", 5: ""}


def test_few_changes_ask_for_nothing(spark):
    entry = "alternatives array<struct<alt:string,is_remove:boolean>>"
    rows = [(1, 0, "x", None, [("y", False)]), (2, 0, "x", None, [("y", False)]), (2, 5, "z", None, [(None, True)]), (3, 0, "q", "why", [])]
    frame = spark.createDataFrame(rows, f"doc_id int, start int, text string, explanation string, {entry}")
    assert {r["doc_id"] for r in guardrail.quoted(frame).collect()} == {1, 2, 3}
    assert {r["doc_id"] for r in guardrail.quoted(frame, min_changes=0).collect()} == {1, 2}
    assert {r["doc_id"] for r in guardrail.quoted(frame, min_changes=1).collect()} == {2}


def replay(spark, tmp_path, batches, schema, job, mode):
    """Rows that a job writes when each list of rows comes as a batch of its own."""
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    return streams.drain(job(source.withColumn("ts", F.timestamp_seconds("at"))), mode)


def test_guidance_is_given_once_and_again_after_silence(spark, tmp_path):
    day = 86_400
    base = 1_704_067_200
    batches = [
        [(1, 1, "b", "G", base + 60), (1, 0, "a", "G", base)],
        [(1, 2, "c", "G", base + 120), (2, 0, None, "G", base + 120)],
        [(3, 0, "far", "G", base + 9 * day)],
        [(1, 7, "late", "G", base + 20 * day)],
    ]
    got = replay(spark, tmp_path, batches, "conv_id long, turn int, text string, guidance string, at long", jobs.guided, "append").collect()
    assert sorted((r["conv_id"], r["turn"], r["text"]) for r in got) == [(1, 0, "G\n\na"), (1, 7, "G\n\nlate"), (2, 0, "G\n\n"), (3, 0, "G\n\nfar")]


def test_notes_change_only_with_newer_turns(spark, tmp_path):
    base = 1_704_067_200
    batches = [[(1, 1, "x", base), (1, 3, "y", base)], [(1, 2, "old", base), (2, 1, "", base)], [(1, 4, "y", base)], [(1, 5, "z", base)]]
    got = replay(spark, tmp_path, batches, "conv_id long, turn int, note string, at long", jobs.latest_notes, "update").collect()
    assert sorted((r["conv_id"], r["turn"], r["note"]) for r in got) == [(1, 3, "y"), (1, 5, "z"), (2, 1, "")]
