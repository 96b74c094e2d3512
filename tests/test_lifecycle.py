"""Claims, reservations and sessions with releases and timers."""

import random

import pandas as pd
import pytest

from tidewatch.session import shared_dir
from tidewatch.streaming import leases as L
from tidewatch.streaming import lifecycle as C

T0, US = 1_700_000_000_000_000, 1_000_000
SCHEMA = "key string, event_id long, op string, ref string, ts_us long"


def drained(spark, slices, processor, tmp_path):
    """Results over one micro-batch per slice, and the folder of the state."""
    src, out, state = str(tmp_path / "in"), shared_dir(spark, "life"), shared_dir(spark, "life-state")
    for part in slices:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.STATE_STORE)
    stream = C.life_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), processor)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return {r["event_id"]: r["result"] for r in spark.read.schema(C.OUT).parquet(out).collect()}, state


def kept(spark, state, name, **options):
    return spark.read.format("statestore").option("stateVarName", name).options(**options).load(state).count()


def slices_of(rnd, n, keys, ops, refs):
    at, out = T0, []
    for i in range(n):
        at += rnd.randrange(1, 400) * US
        out.append((rnd.choice(keys), i, rnd.choice(ops), rnd.choice(refs), at))
    step = n // 4
    return [out[i:i + step] for i in range(0, n, step)]


def test_claims_with_release(spark, tmp_path):
    slices = slices_of(random.Random(1), 200, "abc", ["claim", "claim", "lookup", "release"], [""])
    end = max(e[4] for s in slices for e in s)
    # long after, one key claims: the timers of all others fire behind it
    slices.append([("z", 900, "claim", "", end + 10_000 * US)])
    slices.append([("z", 901, "lookup", "", end + 10_001 * US)])
    got, state = drained(spark, slices, C.ClaimLife(600), tmp_path)
    live, want = {}, {}
    for key, i, op, _, ts in sorted((e for s in slices for e in s), key=lambda e: e[4]):
        on = key in live and ts < live[key]
        if op == "claim":
            want[i] = "duplicate" if on else "accepted"
            live[key] = live[key] if on else ts + 600 * US
        elif op == "lookup":
            want[i] = "claimed" if on else "free"
        else:
            want[i] = "released" if on else "noop"
            live.pop(key, None)
    assert got == want and {"accepted", "duplicate", "claimed", "free", "released", "noop"} == set(got.values())
    assert kept(spark, state, "expiry") == 1  # z alone


@pytest.mark.parametrize("op,state,result", [
    ("republish", ("released", "a1", 0), "reserved"), ("reserve", ("released", "a1", 0), "already_completed"), ("republish", ("completed", "a1", 0), "already_completed"),
    ("reserve", ("completed", "", 0), "reserved"), ("republish", ("in_progress", "", T0 + 5 * US), "in_progress"), ("republish", ("in_progress", "a1", T0), "reserved"),
    ("release", ("in_progress", "a1", T0), "released"), ("release", ("completed", "a1", T0), "noop"), ("withdraw", ("completed", "a1", T0), "withdrawn"), ("withdraw", None, "noop"),
])
def test_republish(op, state, result):
    assert C.reserve(state, op, T0, "", 60)[1] == result


def test_reservations_with_timers(spark, tmp_path):
    slices = slices_of(random.Random(2), 200, "abcd", ["reserve", "republish", "complete", "release", "withdraw"], ["", "r1"])
    end = max(e[4] for s in slices for e in s)
    slices += [[("gone", 900, "reserve", "", end + 1 * US)], [("last", 901, "reserve", "", end + 50_000 * US)], [("last", 902, "reserve", "", end + 50_001 * US)]]
    got, state = drained(spark, slices, C.ReservationLife(600), tmp_path)
    records, want = {}, {}
    for key, i, op, ref, ts in sorted((e for s in slices for e in s), key=lambda e: e[4]):
        records[key], want[i] = C.reserve(records.get(key), op, ts, ref, 600)
    assert got == want
    assert kept(spark, state, "record") == sum(1 for k, r in records.items() if r and (r[0] != "in_progress" or r[1] or k == "last"))


def test_sessions(spark, tmp_path):
    slices = slices_of(random.Random(3), 240, "uv", ["create", "create", "lookup", "revoke", "revoke_all"], ["s1", "s2", "s3"])
    end = max(e[4] for s in slices for e in s)
    slices += [[("w", 900, "create", "s1", end + 9_000 * US)], [("w", 901, "lookup", "s1", end + 9_010 * US)]]
    got, state = drained(spark, slices, C.SessionLife(5), tmp_path)  # at least 60 seconds
    live, want = {}, {}
    for key, i, op, ref, ts in sorted((e for s in slices for e in s), key=lambda e: e[4]):
        on = live.get((key, ref), 0) > ts
        if op == "create":
            live[key, ref] = ts + 60 * US
            want[i] = "created"
        elif op == "lookup":
            want[i] = "live" if on else "none"
        elif op == "revoke":
            want[i] = "revoked" if on else "noop"
            live.pop((key, ref), None)
        else:
            want[i] = f"revoked {sum(1 for (k, _), e in live.items() if k == key and e > ts)}"
            live = {k: e for k, e in live.items() if k[0] != key}
    assert got == want and kept(spark, state, "sessions") == 1


class CountedMap(dict):
    """A map state that counts its calls; ``timers`` are those registered with its handle."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getMapState(self, *_):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def _counted(name):
        def call(self, *args):
            self.calls += 1
            return getattr(dict, name)(self, *args)
        return call

    exists, containsKey, getValue, updateValue, removeKey = map(_counted, ("__len__", "__contains__", "get", "__setitem__", "__delitem__"))

    def iterator(self):
        self.calls += 1
        return iter(list(self.items()))


def frame(rows):
    return iter([pd.DataFrame(rows, columns=["key", "event_id", "op", "ref", "ts_us"])])


def test_sessions_call_the_state_store_per_session_not_per_event():
    state, life = CountedMap(), C.SessionLife(60)
    life.init(state)
    rows = [("u", i, ("create", "lookup", "revoke")[i % 3], f"s{i % 2}", T0 + i * US) for i in range(300)] + [("u", 300, "create", "s9", T0 + 300 * US)]
    (out,) = life.handleInputRows(("u",), frame(rows), None)
    assert len(out) == 301 and set(state) == {("s9",)} and state.calls == 2 and len(state.timers) == 1
    (out,) = life.handleInputRows(("u",), frame([("u", 301, "revoke_all", "", T0 + 301 * US)]), None)
    assert out["result"].tolist() == ["revoked 1"] and not state
