import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
BENCHMARK = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
SCHEMAS = {"documents": DOCUMENTS, "pages": PAGES, "labels": LABELS, "benchmark": BENCHMARK}
#: Names that operators use for columns of their own.
CLASHES = [
    "size", "source_size", "target", "taken", "copies", "key", "h", "found", "n", "node", "label", "labels", "toxic", "score", "step", "hashes", "bits",
    "part", "borrowed", "place", "fingerprint", "mix_cut", "copy_id", "rule", "host", "path", "digest", "owner", "id", "shard_", "slice", "slot", "k", "base", "runs",
]


@pytest.fixture
def tables(tmp_path):
    """A function that writes tables from lists of rows and returns their folder; missing tables are empty."""

    def write(clashes=False, **rows):
        folder = tmp_path / f"t{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        for name, schema in SCHEMAS.items():
            given = [dict(zip(schema.names, r)) for r in rows.get(name, [])]
            table = pa.Table.from_pylist(given, schema)
            if clashes:
                for extra in CLASHES:
                    if extra not in schema.names:
                        table = table.append_column(extra, pa.array(["x"] * len(given), pa.string()))
            pq.write_table(table, folder / f"{name}.parquet")
        return str(folder)

    return write


@pytest.fixture
def sql():
    """A function that runs plain SQL over a folder of tables and returns sorted tuples, columns by name."""
    import duckdb

    def run(text, folder):
        con = duckdb.connect()
        for name in SCHEMAS:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        got = con.execute(text)
        names = [c[0] for c in got.description]
        order = sorted(range(len(names)), key=lambda k: names[k])
        return sorted((tuple(r[k] for k in order) for r in got.fetchall()), key=repr)

    return run


def rows(df, *names):
    names = sorted(names or df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


LONG = "lorem ipsum dolor sit amet consectetur " * 20_000

#: Null in every column, empty and blank texts, repeated rows, equal texts, a very long text.
EDGES = [
    (None, "a text without id and some words", "en", "s1", 1),
    (1, None, "en", "s1", 0),
    (2, "", "en", "s2", 0),
    (3, " \t\n\x0b\x0c\r ", "en", None, 0),
    (4, "one two three four five", None, "s1", 0),
    (4, "one two three four five", None, "s1", 0),
    (5, "one two three four five", "en", "s2", None),
    (6, LONG, "en", "s1", 1),
    (7, "ÄÖ\u00a0Ü ß\u2003x", "de", "ß", 1),
    (8, "!!! ... ???", "fr", None, 1),
    (9, "Zz yy", "fr", "", 1),
]
