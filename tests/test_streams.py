"""Streams against plain loops: order, late rows, deadlines, restarts."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from capsule.streaming import rules, stateful

RULES = {"limit": rules.SlidingLimit(3, 600), "lock": rules.Lockout(3, 900), "fetch": rules.FetchCache(1800), "retry": rules.RetryGate(90),
         "pending": stateful.PendingTimeout(600)}
FLAGS = dict.fromkeys(RULES, "ok")
START = dt.datetime(2024, 1, 1)


def micros(ts):
    return int((ts - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def plain(events):
    """Outcomes of events in time order: (rule, id) -> outcome."""
    out = {}
    for key in {e[0] for e in events}:
        mine = sorted((micros(ts), i, ok) for k, ts, i, ok in events if k == key)
        for name, rule in RULES.items():
            if name == "pending":
                for n, (ts, i, ok) in enumerate(mine):
                    if not ok and (n + 1 == len(mine) or mine[n + 1][0] > ts + 600_000_000):
                        out[name, i] = "failed"
                continue
            state = rule.start()
            for ts, i, ok in mine:
                state, x = rule.step(state, ts, ok)
                out[name, i] = str(x).lower() if isinstance(x, bool) else x
    return out


def test_replay_is_the_plain_loop(spark):
    rng, at, events = random.Random(2), START, []
    for i in range(400):
        at += dt.timedelta(seconds=rng.choice([0, 1, 20, 300, 2000]), microseconds=rng.choice([0, 1, 999]))
        events.append((rng.choice("abc"), at, i, rng.random() < 0.4))
    slices = [events[:150], events[150:300], events[300:]]
    # within the lateness order does not matter; what is far behind comes too late
    for s in slices:
        rng.shuffle(s)
    late = [("a", START + dt.timedelta(seconds=s), 1000 + s, False) for s in range(5)]
    schema = "key string, ts timestamp, id long, ok boolean"
    frames = [spark.createDataFrame(s, schema) for s in (slices[0], slices[1] + late, slices[2] + [("b", None, 2000, True), (None, START, 3000, True)])]
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    got = stateful.replay(frames, folder, RULES, FLAGS, "1 seconds")
    rows = got.collect()
    assert {(r.rule, r.id): r.outcome for r in rows} == plain(events) and len(rows) == len(plain(events))
    for r in rows:
        if r.rule == "pending":
            assert r.ts == next(ts for _, ts, i, _ in events if i == r.id) + dt.timedelta(seconds=600)
    every = frames[0].unionByName(frames[1]).unionByName(frames[2])
    left = {r.id for r in stateful.late_rows(every, got, "limit").collect()}
    assert left == {*range(1000, 1005), 2000, 3000}
    # started again on nothing new, nothing is said twice
    run = (stateful.apply_rules(spark.readStream.schema(schema).parquet(f"{folder}/events"), RULES, FLAGS, "1 seconds").writeStream.format("parquet")
           .option("path", f"{folder}/outcomes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    run.awaitTermination()
    assert spark.read.parquet(f"{folder}/outcomes").agg(F.count("*")).first()[0] == len(rows)
