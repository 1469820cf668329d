"""Streams over tables that are one file, a folder of files, or without rows."""

import pytest

from lexiscreen.catalog import streams
from lexiscreen.catalog.registry import QUERIES

TURNS = [(1, 0, "user", "hello"), (1, 1, "assistant", "and that is all"), (1, 3, "assistant", "12 34"), (2, 1, "assistant", "for the cat"), (2, 2, "user", None)]
COLUMNS = "conv_id long, turn int, role string, text string"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    def write(rows, columns, name, files):
        base = str(tmp_path_factory.mktemp("tables"))
        spark.createDataFrame(rows, columns).repartition(files).write.parquet(f"{base}/{name}.parquet")
        return base

    return write


def test_a_folder_of_files_is_one_table(spark, made):
    folder = made(TURNS, COLUMNS, "conversations", 3)
    got = {r["conv_id"]: (r["turn"], r["note"]) for r in QUERIES["r06_note_idempotent"](spark, folder).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 3, 2: 1} and got[1][1] == "" and got[2][1].startswith('"for the"')
    assert {(r["conv_id"], r["turn"]) for r in QUERIES["r05_guidance_once"](spark, folder).collect()} == {(1, 0), (2, 1)}


def test_the_whole_check_over_a_folder(spark, made):
    texts = [(1, "and that is all", "en", "x"), (2, "nothing", "en", None), (3, "für und die", "de", "x")]
    columns = "doc_id long, text string, lang string, source string"
    found = QUERIES["r03_check_stream"](spark, made(texts, columns, "documents", 2)).collect()
    assert {(r["doc_id"], r["rule_id"]) for r in found} == {(1, 2), (1, 5), (3, 23)}


def test_a_stream_without_rows(spark, made):
    folder = made([], COLUMNS, "conversations", 1)
    assert QUERIES["r06_note_idempotent"](spark, folder).collect() == []
    rows = streams.stream(spark, folder, "conversations").groupBy("role").count()
    assert streams.drain(rows, "update").collect() == []
