"""Claims and sessions with their whole life in the stream (STR-02, STR-03, STR-07).

Lookups, releases and revocations are rows of the same stream as the claims, so
they are ordered with them. State is kept per key in RocksDB; an event-time
timer at each expiry removes it, so a key that expired leaves no state row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.streaming import fsm

#: Fixed value: shortest life of a session.
MIN_SESSION_SECONDS = 60
OUT = "key string, event_id long, op string, ref string, result string"


def claim(expiry: int | None, op: str, ts: int, ttl_seconds: int) -> tuple[int | None, str]:
    """STR-01 / STR-02: next expiry of a key (None: no claim) and what happened."""
    live = expiry is not None and ts < expiry
    if op == "lookup":
        return expiry, "claimed" if live else "free"
    if op == "release":
        return None, "released" if live else "noop"
    return (expiry, "duplicate") if live else (ts + ttl_seconds * fsm.US, "accepted")


def reserve(state, op: str, ts: int, ref: str, ttl_seconds: int):
    """STR-03 / STR-04 with ``republish``: an analysis may stand while its
    reservation was released; then only a republishing caller may reserve again.
    ``state`` is None or (status, analysis id, expiry); "released" keeps the
    analysis."""
    status, analysis, expiry = state or ("", "", 0)
    live = status == "in_progress" and ts < expiry
    if op == "complete":
        return ("completed", ref or analysis, fsm.FOREVER), "completed"
    if op == "release":
        if status == "in_progress":
            return (("released", analysis, fsm.FOREVER) if analysis else None), "released"
        return state, "noop"
    if op == "withdraw":  # a finished reservation is dropped, its analysis stays stored
        return (("released", analysis, fsm.FOREVER), "withdrawn") if status == "completed" and analysis else (state, "noop")
    if analysis and (op != "republish" or status == "completed"):
        return state, "already_completed"
    if live:
        return state, "in_progress"
    return ("in_progress", analysis, fsm.lease_end(ts, ttl_seconds)), "reserved"


class _Timed(StatefulProcessor):
    """Rows of a micro-batch in time order, and timers in milliseconds that are
    never early: an expiry within a millisecond fires at the next one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def in_order(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(rows)).sort_values(["ts_us", "event_id"], kind="stable")

    def wake(self, expiry_us: int) -> None:
        self.handle.registerTimer(-(-expiry_us // 1000))

    @staticmethod
    def answer(key, events: pd.DataFrame, results: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"key": str(key[0]), "event_id": events["event_id"].to_numpy(), "op": events["op"].to_numpy(), "ref": events["ref"].to_numpy(), "result": results})

    def close(self) -> None:
        pass


class ClaimLife(_Timed):
    """STR-01 / STR-02: state is the expiry of the live claim."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.expiry = handle.getValueState("expiry", "expiry long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = self.in_order(rows)
        before = expiry = self.expiry.get()[0] if self.expiry.exists() else None
        results = []
        for op, ts in zip(events["op"], events["ts_us"]):
            expiry, result = claim(expiry, op, int(ts), self.ttl)
            results.append(result)
        if expiry is None:
            self.expiry.clear()
        elif expiry != before:
            self.expiry.update((expiry,))
            self.wake(expiry)
        yield self.answer(key, events, results)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer of an earlier claim finds a later expiry and leaves it
        if self.expiry.exists() and self.expiry.get()[0] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.expiry.clear()
        return iter([])


class ReservationLife(_Timed):
    """STR-03 / STR-04: leases that ran out are removed by their timer; finished reservations stay."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.record = handle.getValueState("record", "status string, analysis string, expiry long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = self.in_order(rows)
        before = state = tuple(self.record.get()) if self.record.exists() else None
        results = []
        for op, ts, ref in zip(events["op"], events["ts_us"], events["ref"]):
            state, result = reserve(state, op, int(ts), ref or "", self.ttl)
            results.append(result)
        if state is None:
            self.record.clear()
        elif state != before:
            self.record.update(state)
            if state[0] == "in_progress":
                self.wake(state[2])
        yield self.answer(key, events, results)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.record.get()) if self.record.exists() else None
        if state and state[0] == "in_progress" and state[2] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            if state[1]:
                self.record.update(("released", state[1], fsm.FOREVER))
            else:
                self.record.clear()
        return iter([])


class SessionLife(_Timed):
    """STR-07: sessions of a user: create, lookup, revoke, revoke_all. ``ref``
    names the session; state is one entry per live session."""

    def __init__(self, ttl_seconds: int):
        self.ttl = max(MIN_SESSION_SECONDS, ttl_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sessions = handle.getMapState("sessions", "session string", "expiry long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # every call of the state store is a round trip: one reads all sessions, then only what changed is written
        events = self.in_order(rows)
        before = {k[0]: v[0] for k, v in self.sessions.iterator()}
        now, results = dict(before), []
        for op, ts, ref in zip(*(events[c].tolist() for c in ("op", "ts_us", "ref"))):
            live = ts < now.get(ref, ts)
            if op == "create":
                now[ref] = ts + self.ttl * fsm.US
                results.append("created")
            elif op == "lookup":
                results.append("live" if live else "none")
            elif op == "revoke":
                now.pop(ref, None)
                results.append("revoked" if live else "noop")
            else:
                results.append(f"revoked {sum(ts < e for e in now.values())}")
                now.clear()
        for ref in before.keys() - now.keys():
            self.sessions.removeKey((ref,))
        for ref, expiry in now.items():
            if before.get(ref) != expiry:
                self.sessions.updateValue((ref,), (expiry,))
                self.wake(expiry)
        yield self.answer(key, events, results)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for k in [k for k, v in self.sessions.iterator() if v[0] <= due]:
            self.sessions.removeKey(k)
        return iter([])


def life_stream(events: DataFrame, processor: _Timed, delay: str = "0 seconds", key: str | Column = "key") -> DataFrame:
    """``events``: key, event_id, op, ref and ts_us. ``delay`` is the lateness
    that is still taken; later rows are dropped by the watermark, as their
    state may be gone. Rows of a key meet in one task per micro-batch, which the
    reader's limit per trigger bounds."""
    timed = events.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", delay)
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUT, outputMode="Append", timeMode="EventTime")
