"""Host rules, the Merkle manifest and lexical search: next to SQL, next to a few lines of Python, and on the edges."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiscreen.llm import host_rules, lexical_search, manifest

from .conftest import EDGES, LONG, rows

RANDOM = random.Random(7)


def prose(words, alphabet=40):
    return " ".join(f"w{RANDOM.randrange(alphabet)}" for _ in range(words))


def some_documents():
    made = [(k, prose(60 + k % 40, 500), "en", f"s{k % 4}" if k % 3 else "hot", 1) for k in range(100, 200)]
    made += [(k, prose(5), "en", "thin", 1) for k in range(200, 260)] + [(260, prose(90, 500), "en", "thin", 1)]
    made += [(300 + k, " ".join(f"#{w}" for w in prose(90, 500).split()), "en", "marks", 1) for k in range(30)]
    made += [(340, "same line here\n" * 60, "en", "s1", 1), (341, "same line\nother\nsame line\n \n \nsame line", "en", "s1", 1)]
    return made


@pytest.mark.parametrize("clashes", [False, True])
def test_host_rules_agree_with_sql(spark, tables, sql, clashes):
    folder = tables(clashes, documents=EDGES + some_documents())
    got = rows(host_rules.op11(spark, folder))
    assert got == sql(host_rules.OP11_SQL, folder)


def test_hosts_are_rejected_with_their_good_documents(spark, tables):
    got = {r["doc_id"]: r for r in host_rules.op11(spark, tables(documents=some_documents())).collect()}
    assert got[260]["host_failed"] == "short" and not got[260]["kept"] and not got[260]["base_failed"]
    assert got[300]["host_failed"] == "symbols" and not got[300]["kept"]
    assert got[100]["host_failed"] == "" and got[100]["kept"]


def test_single_bad_document_does_not_condemn_its_host(spark, tables):
    docs = [(k, prose(70, 500), "en", f"h{k % 50}", 1) for k in range(500)] + [(900, "too short", "en", "tiny", 1), (901, prose(70, 500), "en", None, 1)]
    got = {r["doc_id"]: r for r in host_rules.op11(spark, tables(documents=docs)).collect()}
    assert got[900]["base_failed"] and got[900]["host_failed"] == ""
    assert got[901]["kept"] and all(got[k]["kept"] for k in range(500))


def brute_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)})


def test_repeat_words_by_brute_force(spark):
    lists = [prose(n, k).split() for n in (0, 1, 2, 3, 4, 7, 30, 120) for k in (1, 2, 3, 8)]
    frame = spark.createDataFrame(list(enumerate(lists)), "i int, w array<string>").select("i", host_rules.repeat_words(F.col("w")).alias("n"))
    assert {r["i"]: r["n"] for r in frame.collect()} == {i: brute_repeats(w) for i, w in enumerate(lists)}


def test_long_text_is_counted_whole(spark, tables):
    got = host_rules.op11(spark, tables(documents=[(1, LONG, "en", "s", 1)])).first()
    assert (got["n_words"], got["n_repeat_words"], got["base_failed"]) == (LONG.count(" "), LONG.count(" "), True)


# --- manifest


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def brute_proof(levels, k):
    found = []
    for level in levels[:-1]:
        run = level[k - k % 3 : k - k % 3 + 3]
        found += run[: k % 3] + run[k % 3 + 1 :]
        k //= 3
    return found


@pytest.mark.parametrize("levels", [0, 1, 2, 3])
def test_butterfly_gives_the_tree_of_every_size(spark, levels):
    """Groups of all sizes from 1 to 30 and some beyond, so that last runs and partitions of any length occur."""
    sizes = [*range(1, 31), 81, 82, 100]
    leaves = {g: [h([f"{g}-{k}"]) for k in range(n)] for g, n in enumerate(sizes)}
    given = [(f"g{g:03}", k, leaf, h(["x"]) if k == 2 else None) for g, own in leaves.items() for k, leaf in enumerate(own)]
    RANDOM.shuffle(given)
    frame = spark.createDataFrame(given, "name string, k int, digest string, tampered string").repartition(5)
    got = manifest.manifest(frame, "name", "k", "digest", levels).collect()
    trees = {g: brute_tree(own) for g, own in leaves.items()}
    top = brute_tree([t[-1][0] for t in trees.values()])
    assert len(got) == len(given)
    for r in got:
        g = int(r["g"][1:])
        assert r["subroot"] == trees[g][-1][0] and r["root"] == top[-1][0]
        assert r["proof_sha256"] == h(brute_proof(trees[g], r["k"]) + brute_proof(top, g))
        assert (r["folded_root"] == r["root"]) == (r["k"] != 2)


@pytest.mark.parametrize("clashes", [False, True])
@pytest.mark.parametrize("levels", [1, 7])
def test_manifest_agrees_with_sql(spark, tables, sql, clashes, levels):
    docs = [(k, f"text {k}\n\n" if k % 3 else f"ü{k}", None if k % 5 == 0 else "de", f"s{k % 7}" if k % 2 else "hot", k) for k in range(50, 190)]
    folder = tables(clashes, documents=EDGES + docs)
    got = rows(manifest.op12(spark, folder, levels))
    assert got == sql(manifest.OP12_SQL, folder)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_and_of_no_document(spark, tables):
    one = manifest.op12(spark, tables(documents=[(5, "a", "en", None, 1)])).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] == h(["1:5", "-", "2:en", "1:1", "1:a"])
    assert one[0]["proof_sha256"] == h([]) and one[0]["verified"]
    assert manifest.op12(spark, tables(documents=[])).collect() == []


# --- search


@pytest.mark.parametrize("clashes", [False, True])
def test_search_agrees_with_sql(spark, tables, sql, clashes):
    items = [(1, "alpha beta w1 w2"), (2, prose(30, 60)), (3, None), (4, " ..."), (5, "nowhere"), (6, "ÄÖ ß Ä"), (6, "one two"), (None, "w3 zz")]
    ties = [(k, "w1 w2 tie", "en", "s", 1) for k in range(400, 480)] + [(400, "w1 w2 tie", "en", "s", 1)]
    folder = tables(clashes, documents=EDGES + ties + [(k, prose(k % 50, 60), "en", "s", 1) for k in range(100, 200)], benchmark=items)
    assert rows(lexical_search.op13(spark, folder)) == sql(lexical_search.OP13_SQL, folder)


def test_search_without_rows(spark, tables):
    assert lexical_search.op13(spark, tables(documents=EDGES)).collect() == []
    assert lexical_search.op13(spark, tables(benchmark=[(1, "a")])).collect() == []
    assert lexical_search.op13(spark, tables(documents=[(1, "a", "", "", 1)], benchmark=[(1, None)])).collect() == []


def test_blocks_and_tiles_change_nothing(spark, tables, monkeypatch):
    items = [(k, prose(6, 300)) for k in range(40)]
    folder = tables(documents=[(k, prose(40, 300), "en", "s", 1) for k in range(300)], benchmark=items)
    whole = rows(lexical_search.op13(spark, folder, 5))
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 60)
    assert rows(lexical_search.op13(spark, folder, 5)) == whole and len(whole) > 100


def test_tiles_stay_exact_and_ties_are_cut_by_key():
    best = lexical_search.Best(2, 3)
    for keys in ([9, 8, 7], [1, 2, 3], [4, 5, 6]):
        best.add(0, np.array([[5, 0], [5, 1], [4, 1]]), np.zeros(3, np.int64), np.array(keys))
        best.settle()
    item, score, _, key = best.settle()
    assert list(zip(item, score, key)) == [(0, 5, 1), (0, 5, 2), (0, 5, 4), (1, 1, 2), (1, 1, 3), (1, 1, 5)]
    terms = [np.arange(2000), np.array([7, 1999])]
    (first, count, parts), = lexical_search._tiles(terms, 300)
    assert (first, count, len(parts)) == (0, 2, 7) and all(len(own) <= 300 for own, _ in parts)
    assert sum((owner == 1).sum() for _, (_, owner) in parts) == 2


def test_terms_of_long_texts_are_cut_alike(monkeypatch):
    text = "Ab-cd Éé1_x\x00y " * 50
    want = [t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t) for t in re.findall(lexical_search.TERM, text)]
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    assert [w.decode() for part in lexical_search.pieces(text.encode()) for w in part] == want


def test_weight_is_the_floor_of_the_logarithm(spark):
    got = spark.range(1, 50).select(lexical_search.weight(F.lit(100), F.col("id")).alias("w")).collect()
    assert [r["w"] for r in got] == [math.floor(1000 * math.log(202 / (2 * k + 1))) for k in range(1, 50)]
