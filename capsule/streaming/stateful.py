"""Time rules on a stream in event-time order, with timers.

Events wait in the state until the watermark has passed them and are then taken in order, so what arrives out of order within
the allowed lateness changes nothing. A rule may also speak without an event: its deadline is a timer. A key's state goes
once it has been idle for as long as its rules look back. Later events are dropped by the engine; `late_rows` lists them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from capsule import fixed

col = F.col
LATENESS = "10 minutes"
_STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
RESULT = "key {key}, id long, ts timestamp, rule string, outcome string"


class PendingTimeout:
    """A pending turn fails if nothing has finished it after some seconds; an `ok` event finishes it, another one starts anew."""

    state = "id bigint, since bigint"

    def __init__(self, seconds: int = fixed.STALE_PENDING_SECONDS):
        self.seconds = seconds * 1_000_000
        self.idle = seconds

    def start(self):
        return None, None

    def take(self, state, ts, ok, id_):
        return ((None, None) if ok else (id_, ts)), None

    def deadline(self, state):
        return None if state[1] is None else state[1] + self.seconds

    def expire(self, state):
        """State afterwards, and the event that failed."""
        return (None, None), state[0], "failed"


def _outcome(x) -> str | None:
    return str(x).lower() if isinstance(x, bool) else x


class RuleProcessor(StatefulProcessor):
    """All rules over the events of a key. Events are (ts, id, one flag a rule) as numbers; nothing else is kept."""

    def __init__(self, rules: Mapping[str, object]):
        self.rules = dict(rules)
        idle = [r.idle for r in self.rules.values()]
        # a rule without a limit (failures in a row) keeps its state for good
        self.idle = None if None in idle else max(idle) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, id long, flags array<boolean>")
        # timer, last event and the states of all rules are one value: every call to the store is a round trip
        fields, self.places = ["timer long", "last long"], []
        for i, rule in enumerate(self.rules.values()):
            own = [f"r{i}_{f.strip()}" for f in rule.state.split(",")]
            self.places.append(slice(len(fields), len(fields) + len(own)))
            fields += own
        self.kept = handle.getValueState("kept", ", ".join(fields))

    def _start(self) -> list:
        return [x for rule in self.rules.values() for x in rule.start()]

    def handleInputRows(self, key, rows, timerValues):
        new = [(_micros(r.ts), r.id, list(r.flags)) for r in rows if r.id is not None and r.ts is not None]
        if new:
            self.waiting.appendList(new)
            kept, at = self.kept.get(), _wake(min(x[0] for x in new))
            if kept is None or kept[0] is None or at < kept[0]:
                if kept is not None and kept[0] is not None:
                    self.handle.deleteTimer(kept[0])
                self.handle.registerTimer(at)
                self.kept.update((at, *([None, *self._start()] if kept is None else list(kept)[1:])))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seen = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((r[0], r[1], list(r[2])) for r in self.waiting.get())
        due = [e for e in waiting if e[0] <= seen]
        kept = list(self.kept.get())
        rest, last, out, deadlines, states = waiting[len(due):], kept[1], [], [], []
        last = due[-1][0] if due else last
        for i, (name, rule) in enumerate(self.rules.items()):
            state = tuple(list(x) if isinstance(x, (list, tuple)) else x for x in kept[self.places[i]])
            ends = getattr(rule, "deadline", lambda _: None)

            def expired(state, before):
                if ends(state) is not None and ends(state) < before:
                    at = ends(state)
                    state, id_, outcome = rule.expire(state)
                    out.append((key[0], id_, at, name, outcome))
                return state
            for ts, id_, flags in due:
                state = expired(state, ts)
                take = getattr(rule, "take", None)
                state, outcome = take(state, ts, flags[i], id_) if take else rule.step(state, ts, flags[i])
                if outcome is not None:
                    out.append((key[0], id_, ts, name, _outcome(outcome)))
            state = expired(state, seen + 1)
            deadlines += [ends(state)] if ends(state) is not None else []
            states += state
        if due:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        wake = [x[0] for x in rest[:1]] + deadlines
        idle = not wake and self.idle is not None and last is not None
        if idle and seen > last + self.idle:
            self.kept.clear()
        else:
            wake += [last + self.idle + 1] if idle else []
            at = _wake(min(wake)) if wake else None
            if wake:
                self.handle.registerTimer(at)
            self.kept.update((at, last, *states))
        for k, id_, ts, name, outcome in out:
            yield Row(key=k, id=id_, ts=_timestamp(ts), rule=name, outcome=outcome)

    def close(self) -> None:
        pass


def _wake(micros: int) -> int:
    """Millisecond of the timer that goes off once this moment has passed; a key has one at a time."""
    return -(-micros // 1000)


def _micros(ts) -> int:
    import datetime as dt
    ts = ts if ts.tzinfo else ts.astimezone()
    return (ts - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def _timestamp(micros: int):
    import datetime as dt
    return (dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=micros)).astimezone().replace(tzinfo=None)


def apply_rules(events: DataFrame, rules: Mapping[str, object], flags: Mapping[str, str], lateness: str = LATENESS) -> DataFrame:
    """Rows (key, id, ts, rule, outcome) of a stream of events (key, ts, id and the flag column of each rule).

    An outcome comes once the watermark has passed its event, or its deadline. Events of one key that are due in the same
    trigger are sorted in memory, as three numbers each."""
    kind = events.schema["key"].dataType.simpleString()
    narrow = events.select("key", col("ts").cast("timestamp").alias("ts"), col("id").cast("long").alias("id"),
                           F.array(*[col(flags[r]) for r in rules]).alias("flags"))
    return (narrow.withWatermark("ts", lateness).groupBy("key")
            .transformWithState(statefulProcessor=RuleProcessor(rules), outputStructType=RESULT.format(key=kind), outputMode="Append", timeMode="EventTime"))


def replay(slices: list[DataFrame], folder: str, rules: Mapping[str, object], flags: Mapping[str, str], lateness: str = LATENESS) -> DataFrame:
    """Stored events run through the stream, slice by slice: each slice is one trigger of a query that then stops and starts
    again from its checkpoint. A last row without id moves the watermark past everything."""
    spark = slices[0].sparkSession
    # state with timers needs this store; a session that names it already is left as it is
    if spark.conf.get(_STORE_SETTING, "").rsplit(".", 1)[-1] != "RocksDBStateStoreProvider":
        spark.conf.set(_STORE_SETTING, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = slices[0].schema
    end = slices[0].select(F.max(col("ts")).alias("ts"))
    for s in slices[1:]:
        end = end.unionByName(s.select(F.max(col("ts")).alias("ts")))
    end = end.agg((F.max("ts") + F.expr("INTERVAL 3650 DAYS")).alias("ts")).select(
        *[(col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
    for part in [*slices, end]:
        part.write.mode("append").parquet(f"{folder}/events")
        run = (apply_rules(spark.readStream.schema(schema).parquet(f"{folder}/events"), rules, flags, lateness).writeStream.format("parquet")
               .option("path", f"{folder}/outcomes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
        run.awaitTermination()
    kind = schema["key"].dataType.simpleString()
    return spark.read.schema(RESULT.format(key=kind)).parquet(f"{folder}/outcomes")


def late_rows(events: DataFrame, outcomes: DataFrame, rule: str) -> DataFrame:
    """Events that came after the watermark had passed them: `rule`, which speaks for every event, has no outcome for them."""
    return events.join(outcomes.where(col("rule") == rule).select("id").distinct(), "id", "left_anti")
