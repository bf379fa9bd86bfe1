"""SuperMinHash near duplicates and ranked lexical search."""

import random

import brute
import numpy as np
import pytest

from capsule.llm import lexical, superminhash
from capsule.llm.hashed import mixed


def rows(df):
    return [tuple(r) for r in df.collect()]


def random_sets(sizes, seed=1):
    rng = np.random.default_rng(seed)
    return [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in sizes]


def test_signatures_are_those_of_the_shuffles(monkeypatch):
    sets = random_sets((1, 2, 3, 10, 50, 200, 0, 7))

    def mix(x):
        return int(mixed(np.array([x], np.uint64))[0])
    want = [brute.super_min_hash(s.tolist(), 32, mix) for s in sets]
    assert superminhash.signatures(sets, 32).tolist() == want
    monkeypatch.setattr(superminhash, "CHUNK", 7)
    assert superminhash.signatures(sets, 32).tolist() == want


def test_signatures_vary_less_than_independent_ranks():
    found = []
    for seed in range(80):
        every = random_sets([60], seed)[0]
        a, b = superminhash.signatures([every[6:], every[:-6]], 192)
        found.append((a == b).mean())
    assert abs(np.mean(found) - 0.8) < 0.01 and np.std(found) < 0.9 * (0.8 * 0.2 / 192) ** 0.5


@pytest.mark.parametrize("n", [2, 5])
def test_classes(spark, docs, n):
    want = {i: (c[0], c[1], c[1] == i) for i, c in brute.classes([(i, t) for i, t, _ in docs[1]], n, 4, 5).items()}
    got = superminhash.near_duplicates(docs[0], n)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r[0]: r[1:] for r in rows(got)} == want


def chained(many):
    """Texts that differ by a few words from one another: links lead far from the first one."""
    rng = random.Random(9)
    words, out = [f"w{i}" for i in range(60)], []
    for i in range(many):
        words[rng.randrange(60)] = f"x{i}"
        other = list(words)
        other[rng.randrange(60)] = f"y{i}"
        out += [" ".join(words), " ".join(other)]
    return out


def test_large_groups_in_small_cells(spark, monkeypatch):
    texts = list(enumerate(chained(60) + ["one two three four five six"] * 40 + [f"one two three four five six {i}" for i in range(30)]))
    want = {i: c[:2] for i, c in brute.classes(texts, 2, 4, 5).items()}
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    for name, value in (("SLICE", 3), ("BLOCK_NODES", 3), ("BLOCK_SHINGLES", 150)):
        monkeypatch.setattr(superminhash, name, value)
    for bands, rows_ in ((48, 4), (48, 2)):
        assert {r[0]: r[1:3] for r in rows(superminhash.near_duplicates(df, 2, bands=bands, rows=rows_))} == want


def test_classes_of_odd_tables(spark, odd_docs):
    got = rows(superminhash.near_duplicates(odd_docs, 2))
    assert len(got) == odd_docs.count() and superminhash.near_duplicates(odd_docs.limit(0), 2).count() == 0
    by_id = {r[0]: r[1:] for r in got}
    assert by_id[0] == (59, 0, True) and by_id[1] == (59, 0, False) and by_id[2][1] == 0
    assert by_id[3] == by_id[3] == (0, 3, True) and by_id[4] == (0, 4, True) and by_id[5] == (0, 5, True)
    assert by_id[7] == (1, 7, True) and by_id[None] == (2, None, True)
    nameless = spark.createDataFrame([(None, f"{i % 50} " + "a b c d e f g h i j k l m n") for i in range(600)] + [(5, "3 a b c d e f g h i j k l m n o")],
                                     "doc_id long, text string")
    got = rows(superminhash.near_duplicates(nameless, 2))
    assert len(got) == 601 and {r[2] for r in got} == {5} and sum(r[3] for r in got) == 1


def test_search(spark, root, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    want = brute.ranked([(i, t) for i, t, _ in docs[1]], items)
    assert sorted(rows(lexical.op12_lexical_search(spark, root))) == sorted(want)


def test_search_in_small_tiles(spark, docs, root, monkeypatch):
    items = spark.read.parquet(f"{root}/benchmark.parquet").limit(7)
    want = sorted(rows(lexical.search(docs[0], items, 5)))
    for name, value in (("TILE_TERMS", 3), ("GROUP_ITEMS", 2)):
        monkeypatch.setattr(lexical, name, value)
    assert sorted(rows(lexical.search(docs[0].repartition(9), items, 5))) == want


def test_tiles_bound_their_sums():
    group = lexical.Group([(1, "a " * 5000 + "b c"), (2, "b b c d")])
    weight = [40_000_000] * 4
    found = lexical.tiles(group, weight)
    total = np.zeros((4, 2))
    for terms, q in found:
        np.add.at(total, terms, q)
        assert ((q * 40_000_000 * lexical.SATURATION).sum(axis=0) < lexical.EXACT).all()
    assert len(found) > 2 and sorted(total.ravel().tolist()) == [0, 0, 1, 1, 1, 1, 2, 5000]


def test_search_of_odd_tables(spark, odd_docs):
    rows_ = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "T1 t2, t3 t1"), (1, "T1 t2, t3 t1"), (None, "naïve one id w5"), (2, None), (3, ""), (4, " ,;"), (5, "ééé " + "é" * 40_000), (6, "absent")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, score int")
    for k in (2, 20):
        assert sorted(rows(lexical.search(odd_docs, df, k)), key=str) == sorted(brute.ranked(rows_, items, k), key=str)
    assert lexical.search(odd_docs.limit(0), df).count() == 0 and lexical.search(odd_docs, df.limit(0)).count() == 0
