"""Event ingest with expiring per-key state (STR-01..09, STR-11)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.ranking import join_same
from tidewatch.session import shared_dir
from tidewatch.streaming import fsm

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BATCH_ROUNDS = 4  # rounds between two checkpoints
SHARDS = 2048  # groups of keys that share a call of a lease machine


def claims_bypass(key: str) -> Column:
    """STR-01: blank, 'none' and 'unknown' ids are never deduplicated."""
    k = F.lower(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return k.isin(list(fsm.NO_DELIVERY))


def claim_batch(events: DataFrame, keys: Sequence[str], ts: str, ttl_seconds: int, bypass: Column | None = None) -> DataFrame:
    """STR-01 over a finished table: the accepted (key, time) pairs.

    The first event of a key is accepted; the next is the first one at least TTL
    later, and so on. Each round finds the next acceptance of every key by a
    filtered grouped minimum, so a key of any size is pre-aggregated in parallel,
    and leaves the events before it behind. Rounds go on until no event is left;
    every few rounds what remains is cut off with ``checkpoint``. Rows that
    ``bypass`` marks are all accepted and claim nothing."""
    skip = F.lit(False) if bypass is None else bypass
    all_rows = events.select(*keys, F.col(ts).alias("_ts"), skip.alias("_skip"))
    found = all_rows.filter("_skip").select(*keys, F.col("_ts").alias("accepted_at"))
    rows = all_rows.filter(~F.col("_skip")).drop("_skip")
    cut = F.col("accepted_at") + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")
    _ensure_checkpoint_dir(events.sparkSession)
    while True:
        for _ in range(_BATCH_ROUNDS):
            first = rows.groupBy(*keys).agg(F.min("_ts").alias("accepted_at"))
            found = found.unionByName(first)
            rows = join_same(rows, first, keys).filter(F.col("_ts") >= cut).drop("accepted_at")
        rows = rows.checkpoint()
        if rows.isEmpty():
            return found


def release_claims(claims: DataFrame, released: DataFrame, keys: Sequence[str]) -> DataFrame:
    """STR-02: claims whose key was not released since (``released``: keys and released_at)."""
    last = released.groupBy(*keys).agg(F.max("released_at").alias("_at"))
    kept = claims.join(last, list(keys), "left").filter(F.col("_at").isNull() | (F.col("accepted_at") > F.col("_at")))
    return kept.drop("_at")


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "lineage"))


class ClaimProcessor(StatefulProcessor):
    """STR-01 / STR-02 as a stream: state is the expiry of the key's last claim.
    A micro-batch keeps only the times at or after that expiry, as 8-byte numbers."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * fsm.US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expiry = handle.getValueState("expiry", "expiry long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        expiry = self.expiry.get()[0] if self.expiry.exists() else None
        kept = []
        for pdf in rows:
            t = np.unique(pdf["ts_us"].to_numpy(dtype=np.int64))
            kept.append(t if expiry is None else t[t >= expiry])
        times = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
        out, i = [], 0
        while i < len(times):
            out.append(int(times[i]))
            expiry = int(times[i]) + self.ttl
            i = int(np.searchsorted(times, expiry))
        if out:
            self.expiry.update((expiry,))
        yield pd.DataFrame({"key": [str(key[0])] * len(out), "accepted_us": out})

    def close(self) -> None:
        pass


class LeaseProcessor(StatefulProcessor):
    """STR-03..06: one record per key; events of a micro-batch are applied in time
    order. Rows come by shard, as a call and its frames cost more than a key's
    few events: records are map entries of the shard, each read and written at
    most once a micro-batch, and only where its key has events."""

    def __init__(self, step: Callable, ttl_seconds: int, width: int):
        self.step, self.ttl, self.width = step, ttl_seconds, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("records", "key string", "fields array<string>")

    def _load(self, key):
        found = self.records.getValue((key,))
        if found is None:
            return None
        f = list(found[0])
        f[-1] = int(f[-1])
        if self.width == 5:
            f[2] = int(f[2])
        return tuple(f)

    def handleInputRows(self, shard, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts_us", "event_id"], kind="stable")
        any_known = self.records.exists()
        before, states, results = {}, {}, []
        for key, op, ts, ref in zip(*(events[c].tolist() for c in ("key", "op", "ts_us", "ref"))):
            if key not in states:
                before[key] = states[key] = self._load(key) if any_known else None
            states[key], result = self.step(states[key], op, ts, ref, self.ttl)
            results.append(result)
        for key, state in states.items():
            if state == before[key]:
                continue
            if state is None:
                self.records.removeKey((key,))
            else:
                self.records.updateValue((key,), ([str(x) for x in state],))
        yield pd.DataFrame({"key": [str(k) for k in events["key"]], "event_id": events["event_id"].to_numpy(), "op": events["op"].to_numpy(), "result": results})

    def close(self) -> None:
        pass


def claim_stream(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """``events``: (key, ts_us). Rows whose key bypasses claiming are not sent here."""
    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=ClaimProcessor(ttl_seconds), outputStructType="key string, accepted_us long", outputMode="Append", timeMode="None")


def _lease_stream(events: DataFrame, processor: LeaseProcessor, shards: int) -> DataFrame:
    return events.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType="key string, event_id long, op string, result string", outputMode="Append", timeMode="None")


def reservation_stream(events: DataFrame, ttl_seconds: int, shards: int = SHARDS) -> DataFrame:
    """``events``: (key, event_id, op, ts_us, ref). ``shards`` must stay the same for the life of a checkpoint."""
    return _lease_stream(events, LeaseProcessor(fsm.reservation, ttl_seconds, 3), shards)


def dispatch_stream(events: DataFrame, ttl_seconds: int, shards: int = SHARDS) -> DataFrame:
    """As :func:`reservation_stream`."""
    return _lease_stream(events, LeaseProcessor(fsm.dispatch, ttl_seconds, 5), shards)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Drain a stream into Parquet in the shared folder and read it back. File
    sink and checkpoint together make the output exactly-once."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out, ckpt = shared_dir(spark, name), shared_dir(spark, f"{name}-state")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def daily_window_stream(events: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """STR-11: live variant of the daily trend, per UTC day. The watermark bounds
    the state; a zone-less time is read as UTC first."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    w = e.groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.to_date("window.start").alias("day"), "n", "total")


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """Drain an aggregation in complete mode; every micro-batch replaces the table."""
    spark = stream.sparkSession
    out, ckpt = shared_dir(spark, name), shared_dir(spark, f"{name}-state")
    q = (
        stream.writeStream.outputMode("complete").option("checkpointLocation", ckpt).trigger(availableNow=True)
        .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/v{i}")).start()
    )
    q.awaitTermination()
    last = max((p["batchId"] for p in q.recentProgress), default=0)
    return spark.read.schema(stream.schema).parquet(f"{out}/v{last}")


# Actions that lead to an analysis.
PR_ACTIONS = ["opened", "synchronize", "reopened"]
PAYLOAD = (
    "action string, number bigint, repository struct<name:string,owner:struct<login:string>>, "
    "pull_request struct<number:bigint,user:struct<login:string>,head:struct<sha:string>,base:struct<sha:string>>"
)


def project_payload(deliveries: DataFrame) -> DataFrame:
    """STR-09 / SRC-14: typed columns of a JSON payload; malformed text gives NULLs."""
    p = F.from_json("payload", PAYLOAD)
    d = deliveries.withColumn("p", p)
    return d.select(
        *deliveries.columns, F.col("p.repository.owner.login").alias("owner"), F.col("p.repository.name").alias("repository"),
        F.coalesce("p.pull_request.number", "p.number").alias("pr_number"), F.col("p.pull_request.head.sha").alias("head_sha"),
        F.col("p.pull_request.user.login").alias("author"), F.lower(F.trim("p.action")).alias("action"))


def route(deliveries: DataFrame, claimed: str = "claimed") -> DataFrame:
    """STR-08: outcome of a delivery: acknowledged, duplicate, ignored or analyze."""
    missing = F.col("owner").isNull() | F.col("repository").isNull() | F.col("pr_number").isNull() | F.col("head_sha").isNull()
    ev = F.lower(F.trim("event_type"))
    return deliveries.withColumn(
        "outcome",
        F.when(ev == "push", "acknowledged")
        .when(ev != "pull_request", "ignored")
        .when(missing, "acknowledged")
        .when(~F.col(claimed), "duplicate")
        .when(~F.coalesce(F.col("action").isin(PR_ACTIONS), F.lit(False)), "ignored")
        .otherwise("analyze"),
    )


def live_sessions(users: DataFrame, sessions: DataFrame, now: str) -> DataFrame:
    """JOI-01 / STR-07: users with a session that is neither revoked nor expired."""
    s = sessions.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > F.lit(now).cast("timestamp_ntz")))
    return users.join(s, "user_id")


def expired(rows: DataFrame, now: str) -> DataFrame:
    """SNK-16: what a cleanup keeps."""
    return rows.filter(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))


def session_expiry(created: str = "created_at", ttl_seconds: int = 3600) -> Column:
    """SCL-03: end of a session, at least one minute long."""
    return F.col(created) + F.expr(f"INTERVAL {max(60, int(ttl_seconds))} SECONDS")


def retry_delay(attempt: str, retry_after: str, reset_epoch: str, now_epoch: str, factor: float = 1.0, cap: float = 30.0) -> Column:
    """SCL-06: seconds to wait: the server's hint, else its reset time, else
    exponential backoff, always within [0, cap]."""
    hint = F.col(retry_after).try_cast("double")
    dated = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(retry_after, r"^\w+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))) - F.col(now_epoch)
    reset = F.col(reset_epoch).try_cast("double") - F.col(now_epoch)
    wait = F.coalesce(hint, dated.cast("double"), reset, F.lit(factor) * F.pow(F.lit(2.0), F.col(attempt)))
    return F.greatest(F.lit(0.0), F.least(wait, F.lit(cap)))
