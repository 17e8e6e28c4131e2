"""Windows over events of one key: batch forms, and their streaming twins with state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limits of requests, duplicates and logins, in seconds and counts.
RATE_SECONDS, RATE_LIMIT = 60, 30
DUPLICATE_SECONDS = 5
FAILURES, FAILURE_SECONDS, LOCK_SECONDS = 5, 900, 900
SESSION_GAP = 1800


def calendar_rate(events: DataFrame, seconds: int = RATE_SECONDS) -> DataFrame:
    """Requests of each user in fixed windows of the clock: user_id, start, n."""
    w = F.window("ts", f"{seconds} seconds")
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """Runs of a user's events with gaps below `gap` seconds: user_id, start, end (of the last event), n."""
    w = F.session_window("ts", f"{gap} seconds")
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end")).select("user_id", "start", "end", "n")


# ---- steps: from a key's state, a time and a value to the next state and an answer. A state is a tuple, at first of nulls and zeros ----


def since(start: pd.Timestamp | None, ts: pd.Timestamp) -> float:
    return float("inf") if start is None else (ts - start).total_seconds()


def rate_step(state: tuple, ts: pd.Timestamp, _=None, seconds: int = RATE_SECONDS, limit: int = RATE_LIMIT) -> tuple[tuple, bool]:
    """Windows that a user's first request opens; within one, requests beyond the limit are refused. State: opened, count."""
    opened, count = state if since(state[0], ts) < seconds else (ts, 0)
    return (opened, count + 1), count < limit


def duplicate_step(state: tuple, ts: pd.Timestamp, _=None, seconds: int = DUPLICATE_SECONDS) -> tuple[tuple, bool]:
    """Equal requests (the key has their digest) within `seconds` of an accepted one are duplicates. State: last accepted."""
    again = since(state[0], ts) < seconds
    return (state if again else (ts,)), again


def lock_step(state: tuple, ts: pd.Timestamp, failed: bool) -> tuple[tuple, bool]:
    """Logins refused by the lock: FAILURES failures within their window lock for LOCK_SECONDS; a success clears the count. State: opened, count, until."""
    opened, count, until = state
    if until is not None and ts < until:
        return state, True
    if not failed:
        return (None, 0, None), False
    opened, count = (opened, count) if since(opened, ts) < FAILURE_SECONDS else (ts, 0)
    if count + 1 >= FAILURES:
        return (None, 0, ts + pd.Timedelta(seconds=LOCK_SECONDS)), False
    return (opened, count + 1, None), False


#: Of each step: its first state, the state's schema, and the seconds after which a state is as good as none.
RATE, DUPLICATE, LOCK = (
    (rate_step, (None, 0), "opened timestamp, n long", RATE_SECONDS),
    (duplicate_step, (None,), "last timestamp", DUPLICATE_SECONDS),
    (lock_step, (None, 0, None), "opened timestamp, n long, until timestamp", max(FAILURE_SECONDS, LOCK_SECONDS)),
)


def folded(events: DataFrame, key: list[str], kind: tuple, answer: str, value: str | None = None) -> DataFrame:
    """Each key's events (event_id, ts, value) in the order of time, with the step's answer: the key, event_id and the answer.

    Events are dealt by key and sorted; a task walks them batch by batch with the state of one key, however many events that has.
    """
    step, first, _, _ = kind

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, first
        for pdf in batches:
            out = []
            for *own, ts, v in pdf[[*key, "ts", "value_"]].itertuples(index=False):
                if own != now:
                    now, state = own, first
                state, found = step(state, ts, v)
                out.append(found)
            pdf[answer] = out
            yield pdf[[*key, "event_id", answer]]

    rows = events.select(*key, "event_id", "ts", (F.col(value) if value else F.lit(None).cast("boolean")).alias("value_"))
    kinds = dict(rows.dtypes)
    rows = rows.repartition(*key).sortWithinPartitions(*key, "ts", "event_id")
    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (*key, "event_id")) + f", {answer} boolean")


def replayed(kind: tuple, pdf: pd.DataFrame, value: str | None = None) -> list[bool]:
    """The answers to one key's events in their order."""
    step, state, out = kind[0], kind[1], []
    for ts, v in zip(pdf["ts"], pdf[value] if value else [None] * len(pdf), strict=True):
        state, found = step(state, ts, v)
        out.append(found)
    return out


def first_open(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(allowed=replayed(RATE, pdf))


def locked(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(refused=replayed(LOCK, pdf, "failed"))


def stream_folded(events: DataFrame, key: list[str], kind: tuple, answer: str, value: str | None = None, late: str = "10 minutes") -> DataFrame:
    """The streaming form of `folded`: the state of a key is a few values and ends when it is as good as none.

    Events of a micro-batch are taken in the order of their time: the key, event_id, ts and the answer.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    step, first, state_schema, seconds = kind

    def run(_: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        now = tuple(pd.Timestamp(v) if isinstance(f, type(None)) and v is not None else v for v, f in zip(state.get, first, strict=True)) if state.exists else first
        out = []
        for ts, v in zip(rows["ts"], rows["value_"], strict=True):
            now, found = step(now, ts, v)
            out.append(found)
        state.update(tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in now))
        last = rows["ts"].iloc[-1] + pd.Timedelta(seconds=seconds)
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(**{answer: out})[[*key, "event_id", "ts", answer]]

    rows = events.select(*key, "event_id", "ts", (F.col(value) if value else F.lit(None).cast("boolean")).alias("value_")).withWatermark("ts", late)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*key, "event_id", "ts")) + f", {answer} boolean"
    return rows.groupBy(*key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited_stream(events: DataFrame) -> DataFrame:
    return stream_folded(events, ["user_id"], RATE, "allowed")


def suppressed_stream(events: DataFrame) -> DataFrame:
    return stream_folded(events, ["user_id", "digest"], DUPLICATE, "duplicate")


def locked_stream(events: DataFrame) -> DataFrame:
    return stream_folded(events, ["user_id"], LOCK, "refused", "failed")


def gaps(events: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """`sessions` by windows instead of a session aggregate: the session's number for each event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) >= gap * 1_000_000, F.lit(True))
    return events.withColumn("session", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def stream_with_timers(events: DataFrame, key: list[str], kind: tuple, answer: str, value: str | None = None, late: str = "10 minutes", ttl_ms: int | None = None) -> DataFrame:
    """The form of `folded` whose state ends by itself: the key, event_id, ts and the answer.

    An event waits (in a map by time) until the watermark has passed it; a timer wakes its key then, so events that come out of order within `late` are
    answered in the order of their time. Another timer drops the key's state once it is as good as none. With `ttl_ms` nothing waits: events are
    answered at once, in the order of time inside a micro-batch, and state that isn't touched lives so long by the machine's clock.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    step, first, state_schema, seconds = kind
    rows = events.select(*key, "event_id", "ts", (F.col(value) if value else F.lit(None).cast("boolean")).alias("value_")).withWatermark("ts", late)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*key, "event_id", "ts")) + f", {answer} boolean"
    columns = [*key, "event_id", "ts", answer]
    plain = lambda v: v.to_pydatetime() if isinstance(v, pd.Timestamp) else v

    class Fold(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("state", state_schema, ttl_ms)
            self.last = None if ttl_ms else handle.getValueState("last", "ts timestamp")
            self.waiting = None if ttl_ms else handle.getMapState("waiting", f"ts timestamp, event_id {kinds['event_id']}", "value_ boolean")

        def walked(self, own: tuple, found: list[tuple]) -> Iterator[pd.DataFrame]:
            """Answers to events (ts, event_id, value) in their order; the state after them is kept."""
            held = self.state.get() if self.state.exists() else None
            now, out = (first if held is None else tuple(pd.Timestamp(v) if f is None and v is not None else v for v, f in zip(held, first, strict=True))), []
            for ts, event_id, v in found:
                now, answered = step(now, ts, v)
                out.append((*own, event_id, ts, answered))
            if out:
                self.state.update(tuple(plain(v) for v in now))
                yield pd.DataFrame(out, columns=columns)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            found = [(ts, event_id, None if v is None or pd.isna(v) else bool(v)) for pdf in rows for event_id, ts, v in pdf[["event_id", "ts", "value_"]].itertuples(index=False)]
            if ttl_ms:
                yield from self.walked(key, sorted(found, key=lambda e: e[:2]))
                return
            for ts, event_id, v in found:
                self.waiting.updateValue((plain(ts), event_id), (v,))
                self.handle.registerTimer(int(ts.timestamp() * 1000) + 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            due = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
            held = sorted((pd.Timestamp(ts).tz_localize(None), event_id, v[0]) for (ts, event_id), v in self.waiting.iterator())
            found = [e for e in held if e[0] < due]
            yield from self.walked(key, found)
            for ts, event_id, _ in found:
                self.waiting.removeKey((plain(ts), event_id))
            if found:
                self.last.update((plain(found[-1][0]),))
                self.handle.registerTimer(int(found[-1][0].timestamp() * 1000) + 1000 * seconds + 1)
            elif self.last.exists() and due > pd.Timestamp(self.last.get()[0]).tz_localize(None) + pd.Timedelta(seconds=seconds):
                self.state.clear()
                self.last.clear()

        def close(self) -> None:
            pass

    return rows.groupBy(*key).transformWithStateInPandas(Fold(), schema, "Append", "ProcessingTime" if ttl_ms else "EventTime")
