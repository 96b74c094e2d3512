"""Streaming and state queries (survey 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.plans.registry import query
from tidewatch.sources import bridge as B
from tidewatch.streaming import leases as L
from tidewatch.streaming import lifecycle as Y

WEEK = 7 * 86400
SPAN = 30 * 86400


def stream(spark, d):
    schema = B.table(spark, d, "events").schema
    # a bounded micro-batch bounds what one key can bring to one task
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", 256 * 1024 * 1024).parquet(d)


def micros(c="ts"):
    return F.unix_micros(F.col(c).cast("timestamp"))


# every fiftieth user stands for a sender without delivery ids, whose events are never claimed
CHAIN = f"""WITH RECURSIVE ev AS (SELECT CASE WHEN user_id % 50 = 0 THEN 'None' ELSE CAST(user_id AS VARCHAR) END AS delivery_id, ts FROM events),
  chain AS (SELECT delivery_id, min(ts) AS t FROM ev WHERE delivery_id <> 'None' GROUP BY 1
    UNION ALL SELECT c.delivery_id, (SELECT min(e.ts) FROM ev e WHERE e.delivery_id = c.delivery_id AND e.ts >= c.t + INTERVAL {WEEK} SECOND)
      FROM chain c WHERE c.t IS NOT NULL)"""


def deliveries(events):
    return events.select(F.when(F.col("user_id") % 50 == 0, "None").otherwise(F.col("user_id").cast("string")).alias("delivery_id"), "ts")


@query("delivery_claims", CHAIN + " SELECT delivery_id, t AS accepted_at FROM chain WHERE t IS NOT NULL UNION ALL SELECT delivery_id, ts FROM ev WHERE delivery_id = 'None'")
def _(spark, d):
    return L.claim_batch(deliveries(B.table(spark, d, "events")), ["delivery_id"], "ts", WEEK, L.claims_bypass("delivery_id"))


@query(
    "delivery_claims_stream",
    CHAIN + " SELECT delivery_id AS key, epoch_us(t) AS accepted_us FROM chain WHERE t IS NOT NULL UNION ALL SELECT delivery_id, epoch_us(ts) FROM ev WHERE delivery_id = 'None'",
)
def _(spark, d):
    e = deliveries(stream(spark, d)).select(F.col("delivery_id").alias("key"), micros().alias("ts_us"))
    free = L.run_to_table(e.filter(L.claims_bypass("key")).withColumnRenamed("ts_us", "accepted_us"), "unclaimed")
    return L.run_to_table(L.claim_stream(e.filter(~L.claims_bypass("key")), WEEK), "claims").unionByName(free)


def lease_events(df):
    t = F.col("event_type")
    op = F.when(t == "purchase", "complete").when(t == "error", "release").otherwise("reserve")
    return df.select(F.col("user_id").cast("string").alias("key"), "event_id", op.alias("op"), micros().alias("ts_us"),
                     F.when(t == "purchase", F.concat(F.lit("a"), F.col("event_id").cast("string"))).otherwise("").alias("ref"))


def dispatch_events(df):
    t = F.col("event_type")
    op = F.when(t == "purchase", "failure").when(t == "error", "unknown").when(t == "signup", "success").otherwise("claim")
    ref = F.when(t == "purchase", F.when(F.col("value") > 450, "|http_400").otherwise("|http_500")).otherwise("")
    return df.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.to_date("ts").cast("string")).alias("key"), "event_id", op.alias("op"),
                     micros().alias("ts_us"), ref.alias("ref"))


RESERVATIONS = """WITH RECURSIVE ev AS (
    SELECT CAST(user_id AS VARCHAR) AS key, event_id, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'release' ELSE 'reserve' END AS op, epoch_us(ts) AS t,
      CASE WHEN event_type = 'purchase' THEN 'a' || event_id ELSE '' END AS ref, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  st AS (
    SELECT DISTINCT key, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS event_id, '' AS op, '' AS result, 'none' AS status, '' AS analysis, CAST(0 AS BIGINT) AS expiry FROM ev
    UNION ALL
    SELECT key, rn, event_id, op, result,
      CASE result WHEN 'completed' THEN 'completed' WHEN 'released' THEN 'none' WHEN 'reserved' THEN 'in_progress' ELSE status END,
      CASE result WHEN 'completed' THEN coalesce(nullif(ref, ''), analysis) WHEN 'released' THEN '' WHEN 'reserved' THEN '' ELSE analysis END,
      CASE result WHEN 'reserved' THEN t + 3600000000 ELSE expiry END
    FROM (SELECT e.*, s.status, s.analysis, s.expiry,
        CASE WHEN e.op = 'complete' THEN 'completed' WHEN e.op = 'release' THEN CASE s.status WHEN 'in_progress' THEN 'released' ELSE 'noop' END
          WHEN s.status = 'completed' AND s.analysis <> '' THEN 'already_completed' WHEN s.status = 'in_progress' AND e.t < s.expiry THEN 'in_progress' ELSE 'reserved' END AS result
      FROM st s JOIN ev e ON e.key = s.key AND e.rn = s.rn + 1))
  SELECT key, event_id, op, result FROM st WHERE rn > 0"""


@query("reservation_fsm", RESERVATIONS)
def _(spark, d):
    return L.run_to_table(L.reservation_stream(lease_events(stream(spark, d)), 3600), "reservations")


DISPATCHES = """WITH RECURSIVE ev AS (
    SELECT user_id || ':' || CAST(ts AS DATE) AS key, event_id, CASE event_type WHEN 'purchase' THEN 'failure' WHEN 'error' THEN 'unknown' WHEN 'signup' THEN 'success' ELSE 'claim' END AS op,
      epoch_us(ts) AS t, CASE WHEN event_type <> 'purchase' THEN 'unknown' WHEN value > 450 THEN 'http_400' ELSE 'http_500' END AS why,
      row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events),
  st AS (
    SELECT DISTINCT key, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS event_id, '' AS op, '' AS result, 'none' AS status, 0 AS attempts, '' AS reason, CAST(0 AS BIGINT) AS expiry FROM ev
    UNION ALL
    SELECT key, rn, event_id, op, result,
      CASE result WHEN 'sent' THEN 'sent' WHEN 'failure' THEN 'failed' WHEN 'unknown' THEN 'unknown' WHEN 'claimed' THEN 'sending' ELSE status END,
      CASE WHEN result = 'claimed' THEN attempts + 1 WHEN result = 'sent' AND status = 'none' THEN 1 ELSE attempts END,
      CASE WHEN result IN ('failure', 'unknown') THEN why ELSE reason END, CASE result WHEN 'claimed' THEN t + 3600000000 ELSE expiry END
    FROM (SELECT e.*, s.status, s.attempts, s.reason, s.expiry,
        CASE WHEN e.op = 'success' THEN CASE WHEN s.status IN ('none', 'sending') THEN 'sent' ELSE 'rejected' END
          WHEN e.op IN ('failure', 'unknown') THEN CASE WHEN s.status IN ('none', 'sent') THEN 'rejected' ELSE e.op END
          WHEN s.status = 'none' THEN 'claimed' WHEN s.status = 'sent' THEN 'already_sent' WHEN s.status = 'sending' AND e.t < s.expiry THEN 'in_progress'
          WHEN s.status = 'failed' AND s.reason IN ('http_400') THEN 'terminal_failure' WHEN s.status = 'unknown' THEN 'ambiguous_delivery_held'
          WHEN s.attempts >= 3 THEN 'max_attempts_exceeded' ELSE 'claimed' END AS result
      FROM st s JOIN ev e ON e.key = s.key AND e.rn = s.rn + 1))
  SELECT key, event_id, op, result FROM st WHERE rn > 0"""


@query("dispatch_fsm", DISPATCHES)
def _(spark, d):
    return L.run_to_table(L.dispatch_stream(dispatch_events(stream(spark, d)), 3600), "dispatches")


DAY = 86400


def life(spark, d, op, ref, processor, name):
    """Events as rows of a life: what happens by event type, micro-batches may come in any order within the span of the table."""
    e = stream(spark, d).select(F.col("user_id").cast("string").alias("key"), "event_id", op.alias("op"), ref.alias("ref"), micros().alias("ts_us"))
    return L.run_to_table(Y.life_stream(e, processor, f"{SPAN} seconds"), name).select("key", "event_id", "op", "result")


def _life_sql(op: str, ref: str, start: str, result: str, after: str) -> str:
    """One row per event: ``result`` from the state before, ``after`` from result and state."""
    return f"""WITH RECURSIVE ev AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, {op} AS op, {ref} AS ref, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      st AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS event_id, '' AS op, '' AS result, {start} FROM ev
        UNION ALL SELECT key, rn, event_id, op, result, {after} FROM (SELECT e.*, s.* EXCLUDE (key, rn), {result} AS result FROM (SELECT * EXCLUDE (event_id, op, result) FROM st) s JOIN ev e ON e.key = s.key AND e.rn = s.rn + 1))
      SELECT key, event_id, op, result FROM st WHERE rn > 0"""


@query(
    "claim_release_stream",
    _life_sql(
        "CASE event_type WHEN 'error' THEN 'release' WHEN 'signup' THEN 'lookup' ELSE 'claim' END", "''", "CAST(0 AS BIGINT) AS expiry",
        "CASE op WHEN 'lookup' THEN CASE WHEN t < expiry THEN 'claimed' ELSE 'free' END WHEN 'release' THEN CASE WHEN t < expiry THEN 'released' ELSE 'noop' END "
        "ELSE CASE WHEN t < expiry THEN 'duplicate' ELSE 'accepted' END END",
        f"CASE WHEN result = 'accepted' THEN t + {DAY}000000 WHEN op = 'release' THEN 0 ELSE expiry END"),
)
def _(spark, d):
    t = F.col("event_type")
    op = F.when(t == "error", "release").when(t == "signup", "lookup").otherwise("claim")
    return life(spark, d, op, F.lit(""), Y.ClaimLife(DAY), "claim-life")


@query(
    "reservation_republish_stream",
    _life_sql(
        "CASE WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'error' THEN CASE WHEN value > 250 THEN 'withdraw' ELSE 'release' END WHEN event_type = 'signup' THEN 'republish' ELSE 'reserve' END",
        "CASE WHEN event_type = 'purchase' AND value < 300 THEN 'a' || event_id ELSE '' END", "'' AS status, '' AS analysis, CAST(0 AS BIGINT) AS expiry",
        "CASE WHEN op = 'complete' THEN 'completed' WHEN op = 'release' THEN CASE status WHEN 'in_progress' THEN 'released' ELSE 'noop' END "
        "WHEN op = 'withdraw' THEN CASE WHEN status = 'completed' AND analysis <> '' THEN 'withdrawn' ELSE 'noop' END "
        "WHEN analysis <> '' AND (op <> 'republish' OR status = 'completed') THEN 'already_completed' WHEN status = 'in_progress' AND t < expiry THEN 'in_progress' ELSE 'reserved' END",
        "CASE result WHEN 'completed' THEN 'completed' WHEN 'released' THEN 'released' WHEN 'withdrawn' THEN 'released' WHEN 'reserved' THEN 'in_progress' ELSE status END, "
        "CASE WHEN result = 'completed' AND ref <> '' THEN ref ELSE analysis END, CASE result WHEN 'reserved' THEN t + 43200000000 ELSE expiry END"),
)
def _(spark, d):
    t, v = F.col("event_type"), F.col("value")
    op = F.when(t == "purchase", "complete").when(t == "error", F.when(v > 250, "withdraw").otherwise("release")).when(t == "signup", "republish").otherwise("reserve")
    ref = F.when((t == "purchase") & (v < 300), F.concat(F.lit("a"), F.col("event_id").cast("string"))).otherwise("")
    return life(spark, d, op, ref, Y.ReservationLife(DAY // 2), "reservation-life")


# a session of a user is named by the number of its device (0 to 3): live from its last creation for two days, unless it or all were revoked since
SESSIONS = f"""WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, CASE event_type WHEN 'error' THEN CASE WHEN value > 250 THEN 'revoke_all' ELSE 'revoke' END WHEN 'view' THEN 'lookup' ELSE 'create' END AS op,
    event_id % 4 AS dev, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  dev AS (SELECT DISTINCT key, dev AS of_dev FROM ev),
  seen AS (SELECT ev.*, of_dev, last_value(CASE WHEN op = 'create' AND dev = of_dev THEN t + {2 * DAY}000000 WHEN op = 'revoke_all' OR op = 'revoke' AND dev = of_dev THEN 0 END IGNORE NULLS)
      OVER (PARTITION BY ev.key, of_dev ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expiry FROM ev JOIN dev ON ev.key = dev.key),
  live AS (SELECT key, event_id, op, count(*) FILTER (WHERE dev = of_dev AND t < expiry) AS own, count(*) FILTER (WHERE t < expiry) AS others FROM seen GROUP BY 1, 2, 3)
  SELECT key, event_id, op, CASE op WHEN 'create' THEN 'created' WHEN 'lookup' THEN CASE own WHEN 1 THEN 'live' ELSE 'none' END WHEN 'revoke' THEN CASE own WHEN 1 THEN 'revoked' ELSE 'noop' END
    ELSE 'revoked ' || others END AS result FROM live"""


@query("session_life_stream", SESSIONS)
def _(spark, d):
    t = F.col("event_type")
    op = F.when(t == "error", F.when(F.col("value") > 250, "revoke_all").otherwise("revoke")).when(t == "view", "lookup").otherwise("create")
    return life(spark, d, op, (F.col("event_id") % 4).cast("string"), Y.SessionLife(2 * DAY), "session-life")


@query("stream_daily_window", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def _(spark, d):
    return L.run_complete(L.daily_window_stream(stream(spark, d)), "daily")


PAYLOAD = """CASE event_type WHEN 'error' THEN '{broken' ELSE '{"action":"' || (CASE event_type WHEN 'click' THEN 'Opened' WHEN 'view' THEN 'closed' ELSE 'synchronize' END)
   || '","repository":{"name":"r","owner":{"login":"o' || user_id || '"}},"pull_request":{"number":' || event_id || ',"head":{"sha":"s' || event_id || '"}}}' END"""


@query(
    "webhook_routing",
    """WITH f AS (SELECT *, ts = min(ts) OVER (PARTITION BY user_id, event_type) AS claimed, CASE WHEN value > 400 THEN 'push' ELSE 'pull_request' END AS ev FROM events)
       SELECT event_id, CASE WHEN event_type <> 'error' THEN 'o' || user_id END AS owner, CASE WHEN ev = 'push' THEN 'acknowledged' WHEN event_type = 'error' THEN 'acknowledged'
         WHEN NOT claimed THEN 'duplicate' WHEN event_type = 'view' THEN 'ignored' ELSE 'analyze' END AS outcome FROM f""",
)
def _(spark, d):
    e = B.table(spark, d, "events")
    first = L.claim_batch(e, ["user_id", "event_type"], "ts", SPAN * 2)
    t = F.col("event_type")
    act = F.when(t == "click", "Opened").when(t == "view", "closed").otherwise("synchronize")
    body = F.concat(F.lit('{"action":"'), act, F.lit('","repository":{"name":"r","owner":{"login":"o'), F.col("user_id").cast("string"),
                    F.lit('"}},"pull_request":{"number":'), F.col("event_id").cast("string"), F.lit(',"head":{"sha":"s'), F.col("event_id").cast("string"), F.lit('"}}}'))
    rows = e.join(first, ["user_id", "event_type"]).select(
        "event_id", F.when(t == "error", "{broken").otherwise(body).alias("payload"), (F.col("ts") == F.col("accepted_at")).alias("claimed"),
        F.when(F.col("value") > 400, "push").otherwise("pull_request").alias("event_type"))
    return L.route(L.project_payload(rows)).select("event_id", "owner", "outcome")


def sessions(spark, d):
    e = B.table(spark, d, "events")
    return e.select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("created_at"),
                    L.session_expiry("ts", WEEK).alias("expires_at"), F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"))


@query(
    "session_users",
    f"""SELECT event_id AS session_id, c_custkey AS user_id, c_name AS full_name FROM events JOIN customer ON c_custkey = user_id
        WHERE event_type <> 'error' AND ts + INTERVAL {WEEK} SECOND > TIMESTAMP '{B.EVENTS_NOW}'""",
)
def _(spark, d):
    users = B.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name"))
    return L.live_sessions(users, sessions(spark, d), B.EVENTS_NOW).select("session_id", "user_id", "full_name")


@query(
    "session_cleanup",
    f"SELECT count(*) AS kept FROM events WHERE ts + INTERVAL {WEEK} SECOND > TIMESTAMP '{B.EVENTS_NOW}'",
)
def _(spark, d):
    return L.expired(sessions(spark, d), B.EVENTS_NOW).agg(F.count(F.lit(1)).alias("kept"))


@query(
    "retry_delays",
    """SELECT event_id, round(greatest(0.0, least(30.0, CASE event_type WHEN 'click' THEN value / 10 WHEN 'view' THEN value - 100 ELSE pow(2.0, user_id % 8) END)), 6) AS delay FROM events""",
)
def _(spark, d):
    t = F.col("event_type")
    e = B.table(spark, d, "events").select(
        "event_id", (F.col("user_id") % 8).alias("attempt"), F.when(t == "click", (F.col("value") / 10).cast("string")).alias("retry_after"),
        F.when(t == "view", (F.col("value") + 900).cast("string")).alias("reset"), F.lit(1000).alias("now"))
    return e.select("event_id", F.round(L.retry_delay("attempt", "retry_after", "reset", "now"), 6).alias("delay"))
