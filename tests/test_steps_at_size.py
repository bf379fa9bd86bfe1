"""What steps cost a row: facts once a part, methods the JVM compiles, search without a sort of each row, pairs sent once."""

import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from capsule.catalog import Tables
from capsule.operators import cells, similarity
from capsule.plans import evaluate as plan
from capsule.sources import staging


def test_facts_of_a_closet_come_with_its_parts(spark, root):
    t = Tables(spark, root)
    c = t.closet()
    by_item = plan.closet_facts(plan.with_kind(c, plan.kinds_of(c))).select("item_id", *plan.RESOLVED, *plan.WORTH)
    by_part = plan.closet_facts(t.kinded_closet())
    assert by_part.columns == t.kinded_closet().columns
    assert by_part.select(*by_item.columns).exceptAll(by_item).isEmpty() and by_part.count() == by_item.count() > 0


def test_written_steps_have_compiled_methods(spark):
    seen = []
    with staging.compiled(spark):
        seen.append(spark.conf.get(staging.METHOD_LIMIT))
    assert seen == ["8000"] and staging.METHOD_LIMIT not in spark.conf.getAll
    spark.conf.set(staging.METHOD_LIMIT, "9000")
    try:
        with staging.compiled(spark):
            assert spark.conf.get(staging.METHOD_LIMIT) == "9000"
        assert spark.conf.get(staging.METHOD_LIMIT) == "9000"
    finally:
        spark.conf.unset(staging.METHOD_LIMIT)


def side(rng, n, m, texts):
    """One cell with ties, and ids on both sides."""
    some = rng.normal(size=(30, 8))
    some /= np.linalg.norm(some, axis=1)[:, None]
    given = {c: pa.array([some[k].tolist() for k in rng.integers(30, size=n + m)], pa.list_(pa.float64())) for c in ("image", "text")}
    rows = {"cell": ["c"] * (n + m), "role": pa.array([0] * n + [1] * m, pa.int32()), "id": [f"x{k}" for k in rng.integers(n + m, size=n + m)],
            "at": pa.array(range(n + m), pa.int64()), "weight": [0.3 if texts else 0.0] * (n + m), "image": given["image"]}
    return pa.table(rows | ({"text": given["text"]} if texts else {}))


@pytest.mark.parametrize("texts", [False, True])
@pytest.mark.parametrize("size", [(5, 8), (40, 300)])
def test_search_against_a_sort_of_each_row(size, texts):
    n, m = size
    t = side(np.random.default_rng(n), n, m, texts)
    rows = t.to_pylist()
    for k in (1, 3):
        got = similarity._search(t, np.zeros(1, np.int64), k).to_pylist()
        want = []
        for a in rows[:n]:
            found = []
            for b in rows[n:]:
                img = round(float(np.dot(a["image"], b["image"])), 12)
                txt = round(float(np.dot(a["text"], b["text"])), 12) if texts else img
                if a["id"] != b["id"]:
                    found.append((-round((1 - a["weight"]) * img + a["weight"] * txt, 9), -round(img, 9), b["at"], a["id"], b["id"]))
            want += sorted(found)[:k]
        assert [(-round(r["similarity"], 9), -round(r["image_similarity"], 9), r["at"], r["cand_id"], r["item_id"]) for r in got] == want


def test_more_candidates_of_a_cell_are_no_more_steps():
    def calls(t):
        n = [0]
        sys.setprofile(lambda frame, event, arg: n.__setitem__(0, n[0] + (event in ("call", "c_call"))))
        try:
            similarity._search(t, np.zeros(1, np.int64), 1)
        finally:
            sys.setprofile(None)
        return n[0]
    rng = np.random.default_rng(1)
    assert calls(side(rng, 400, 50, True)) < 2 * calls(side(rng, 20, 50, True))


@pytest.mark.parametrize("block", [3, 1024])
def test_items_of_one_cell_are_sent_once(spark, block, monkeypatch):
    sent, real = [], cells.run_cells
    monkeypatch.setattr(cells, "run_cells", lambda rows, *a, **k: sent.append(rows.count()) or real(rows, *a, **k))
    rng = np.random.default_rng(2)
    rows = [(u, f"i{u}_{k}", rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for u in range(6) for k in range(1 + u)]
    items = spark.createDataFrame([*rows, rows[-1]], "user_id int, item_id string, image array<double>, text array<double>")
    stats = similarity.pair_statistics(items, by=["user_id"], block=block).collect()
    assert block == 3 or sent == [len(rows) + 1]
    every = [*rows, rows[-1]]
    pairs = [(a, b) for a in every for b in every if a[0] == b[0] and a[1] < b[1]]
    for kind, of in (("image", lambda a, b: np.dot(a[2], b[2])), ("blend", lambda a, b: 0.7 * np.dot(a[2], b[2]) + 0.3 * np.dot(a[3], b[3]))):
        found = sorted(v for r in stats if r["kind"] == kind for v in [r["value"]] * r["n"])
        assert np.allclose(found, sorted(of(a, b) for a, b in pairs), atol=2e-5)
