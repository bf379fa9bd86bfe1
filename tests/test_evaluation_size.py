"""What one evaluation shuffles and writes: kinds once a part, no map of an owner with each candidate, no look shuffled again."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from capsule.catalog import Tables
from capsule.operators import cells, looks
from capsule.plans import evaluate as plan

VEC = {"image": "image_key", "text": "text_key", "style": "style_key"}


def test_kinds_are_resolved_once_a_part(spark, root):
    t = Tables(spark, root)
    c = t.closet()
    by_text, by_part = plan.with_kind(c, plan.kinds_of(c)), t.kinded_closet()
    assert by_part.count() == by_text.count() > 0
    assert by_part.select(*by_text.columns).exceptAll(by_text).count() == 0


def test_candidates_carry_no_map_and_the_closet_meets_no_kinds(spark, root, monkeypatch):
    t, asked = Tables(spark, root), []
    real = plan.kinds_of
    t.kinded_closet()
    monkeypatch.setattr(plan, "kinds_of", lambda items: asked.append("compat_threshold" in items.columns) or real(items))
    users = F.col("user_id") % 20 == 0
    e = plan.evaluate(t.refs(t.candidates().where(users), **VEC), t.refs(t.kinded_closet().where(users), **VEC), vectors=t.referable())
    assert asked == [True]  # the candidates, not the closet
    assert "types" not in e.candidates.columns
    assert e.results.select("type_count").where("type_count is null").count() == 0


ROW = {"owner": "u", "tag": None, "at": 1, "ref": None, "ref2": None, "kind": None, "mask": 3, "all_mask": 3, "pool": 3, "free": 0,
       "n": 1, "inner": 0.0, "use_fin": True, "need": None, "beats": 0, "extends": False, "most": 0, "blocks": 1, "cell": "u", "second": None}


def table(rows):
    types = {"need": pa.list_(pa.float64()), "vec": pa.list_(pa.float64()), "second": pa.list_(pa.float64()), "ref": pa.int64(), "ref2": pa.int64(),
             "tag": pa.string(), "kind": pa.int32()}
    rows = [ROW | r for r in rows]
    return pa.table({c: pa.array([r[c] for r in rows], types.get(c)) for c in rows[0]})


def test_repeated_items_come_out_as_the_aggregate_left_them():
    floor = [-9.0] * 4
    rows = [dict(role=0, id=i, tag="cand", kind=2, need=floor, extends=True, ref=1, vec=[1.0, 0.0]) for i in ("a", "a", "b")]
    rows += [dict(role=1, id=i, kind=2, ref=r, vec=v) for i, r, v in (("x", 2, [0.6, 0.8]), ("x", 3, [0.8, 0.6]), ("y", 4, [0.0, 1.0]))]
    rows += [dict(role=2, id=i, at=at, ref=5, vec=[0.0, 1.0]) for i, at in (("s", 7), ("r", 8))]
    t = table(rows)
    every = pa.Table.from_batches(looks._best_looks(t, np.zeros(1, np.int64))).to_pylist()
    once = pa.Table.from_batches(looks._best_looks(t, np.zeros(1, np.int64), whole=True)).to_pylist()
    best = {}
    for r in every:
        key, worth = (r["tag"], r["left_id"], r["ext_id"], r["new_id"]), (-r["total"], r["fin_at"], r["fin_id"], r["n"], r["base"], r["vec"], r["vec2"])
        best[key] = min(best.get(key, worth), worth)
    assert len(every) == 9 and len(once) == len(best) == 4
    assert {(r["tag"], r["left_id"], r["ext_id"], r["new_id"]): (-r["total"], r["fin_at"], r["fin_id"], r["n"], r["base"], r["vec"], r["vec2"])
            for r in once} == best


def test_a_repeated_new_item_makes_no_look():
    floor = [-9.0] * 4
    rows = [dict(role=0, id="a", tag="shoe3g", kind=2, need=floor, beats=3, use_fin=True, ref=1, vec=[1.0, 0.0]),
            dict(role=1, id="x", kind=2, ref=2, vec=[0.6, 0.8])]
    rows += [dict(role=3, id=i, kind=3, ref=6, vec=[0.6, 0.8]) for i in ("n", "n", "m")]
    once = pa.Table.from_batches(looks._best_looks(table(rows), np.zeros(1, np.int64), whole=True)).to_pylist()
    assert [r["new_id"] for r in once] == ["m"]


def test_no_look_of_a_small_owner_is_shuffled_again(spark, root, monkeypatch):
    found, real = [], cells.run_cells
    monkeypatch.setattr(cells, "run_cells", lambda *a, **k: found.append(real(*a, **k)) or found[-1])
    t = Tables(spark, root)
    users = F.col("user_id") % 50 == 0
    made = []
    meet = looks._meet
    monkeypatch.setattr(looks, "_meet", lambda *a, **k: made.append(meet(*a, **k)) or made[-1])
    plan.evaluate(t.refs(t.candidates().where(users), **VEC), t.refs(t.kinded_closet().where(users), **VEC), vectors=t.referable())
    assert len(made) == 2
    for df in made:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text[:text.index("MapInArrow")]
