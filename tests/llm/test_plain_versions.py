"""Mixing, likelihood ratios and the learner against plain loops."""

import math
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from capsule.llm import classifier, mixing, queries, rules
from capsule.llm.common import n_words


def plain_mix(rows, most=3):
    """(doc_id, source, size, key) -> doc_id: words taken, by serving every queue in turn of finish time."""
    sizes = Counter()
    for _, source, size, _ in rows:
        sizes[source] += size
    target, order = brute.targets(sizes), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    tickets = []
    for place, source in enumerate(order):
        queue = sorted(((key % mixing.BUCKETS, key, i, size) for i, s, size, key in rows if s == source))
        for turn in range(most):
            upto = turn * sizes[source]
            for _, key, i, size in queue:
                upto += size
                if size and target[source] > 0:
                    tickets.append((upto / target[source], place, turn, key, i, size))
    taken, left = Counter(), sum(sizes.values())
    for *_, i, size in sorted(tickets):
        if size > left:
            break
        left -= size
        taken[i] += size
    return taken


def test_mixing_is_the_plain_queue(spark, root, docs):
    sized = docs[0].select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows = [tuple(r) for r in sized.select("*", F.xxhash64(F.lit(0), "doc_id", "size")).collect()]
    want = plain_mix(rows)
    got = {r.doc_id: r.taken for r in queries.QUERIES["op2_weighted_mixing"](spark, root).collect()}
    assert got == {i: want[i] for i in got}


def test_scores_and_verdicts_of_quality_rules(spark, root, docs):
    labels = {r.doc_id for r in spark.read.parquet(f"{root}/labels.parquet").where("quality = 1").collect()}
    held = docs[0].select("doc_id", rules.buckets(rules.word_hashes(F.col("text"))).alias("b")).collect()
    raw, target = Counter(), Counter()
    for r in held:
        raw.update(r.b)
        if r.doc_id in labels:
            target.update(r.b)
    n, m = sum(raw.values()), sum(target.values())
    got = {r.doc_id: r for r in queries.QUERIES["op9_quality_rules"](spark, root).collect()}
    assert len(got) == len(held)
    for r in held:
        each = [math.log((target[b] + 1) / (m + rules.BUCKETS)) - math.log((raw[b] + 1) / (n + rules.BUCKETS)) for b in r.b]
        score, x = sum(each) / len(each) if each else 0.0, got[r.doc_id]
        assert x.score == pytest.approx(score, abs=1e-9)
        assert abs(score - rules.THRESHOLD) < 1e-9 or x.kept == (not x.base_failed and score >= rules.THRESHOLD)


def test_learner_is_the_plain_loop(docs):
    texts = [t.encode() for _, t, _ in docs[1] if t][:60]
    rows = [(p, v, float(i % 3 == 0)) for i, (p, v) in enumerate(classifier.features(texts))]
    z, n, last = Counter(), Counter(), 1 << classifier.BITS

    def weight(i):
        if abs(z[i]) <= classifier.L1:
            return 0.0
        return -(z[i] - math.copysign(classifier.L1, z[i])) / ((classifier.BETA + math.sqrt(n[i])) / classifier.ALPHA + classifier.L2)
    for _ in range(classifier.EPOCHS):
        for places, values, label in rows:
            x = Counter({last: 1.0})
            for p, v in zip(places.tolist(), values.tolist()):
                x[p] += v
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] * x[i] for i in x)))))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / classifier.ALPHA * w[i]
                n[i] += g * g
    got = classifier.ftrl(rows)
    want = np.zeros(last + 1)
    for i in z:
        want[i] = weight(i)
    assert np.allclose(got, want, atol=1e-4) and np.count_nonzero(got) > 100
