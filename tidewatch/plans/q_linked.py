"""Queries over linked tables: saves, cascades, bounded cleanups, lookups (survey 2.1, 2.2)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidewatch.plans.registry import query
from tidewatch.session import shared_dir
from tidewatch.sinks.linked import LinkedTables, retention_cutoff
from tidewatch.sources import bridge as B


def stored(spark, d) -> LinkedTables:
    """Analyses (orders) with their findings (lineitem) and suppressions (orders with a price over 100,000)."""
    t = LinkedTables(spark, shared_dir(spark, "linked"), {"analyses": ["analysis_id"], "findings": ["analysis_id"], "suppressions": ["analysis_id"]}, buckets=16)
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), "o_totalprice")
    f = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("analysis_id"), F.col("l_linenumber").alias("finding_id"), F.col("l_partkey").alias("part"))
    t.save(analyses=o.drop("o_totalprice"), findings=f, suppressions=o.filter("o_totalprice > 100000").select("analysis_id", F.lit("ACTIVE").alias("state")))
    return t


LEFT = """SELECT o_orderkey AS analysis_id, CAST({stay} AS BIGINT) AS analyses, CASE WHEN {stay} = 1 THEN (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) ELSE 0 END AS findings,
  CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS suppressions FROM ({orders})
  WHERE {stay} = 1 OR o_totalprice > 100000"""


def left(t: LinkedTables):
    """Rows by analysis in each of the three tables."""
    rows = None
    for name in t.links:
        part = t.read(name).select("analysis_id", *[F.lit(1 if n == name else 0).alias(n) for n in t.links])
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("analysis_id").agg(*[F.sum(n).alias(n) for n in t.links])


@query("sink_cascade_delete", LEFT.format(stay="CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END", orders="SELECT * FROM orders"))
def _(spark, d):
    t = stored(spark, d)
    t.delete(t.read("analyses").filter("status = 'P'"), cascade=["findings"])
    return left(t)


@query(
    "sink_save_replaces_children",
    """SELECT o_orderkey AS analysis_id, CASE WHEN o_orderstatus = 'F' THEN 'again' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'F'
         THEN (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) ELSE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) END AS findings FROM orders""",
)
def _(spark, d):
    t = stored(spark, d)
    again = t.read("analyses").filter("status = 'F'").withColumn("status", F.lit("again"))
    t.save(analyses=again, findings=t.read("findings").filter("finding_id = 1").join(again.select("analysis_id"), "analysis_id", "left_semi"))
    n = t.read("findings").groupBy("analysis_id").agg(F.count(F.lit(1)).alias("findings"))
    return t.read("analyses").join(n, "analysis_id", "left").select("analysis_id", "status", F.coalesce("findings", F.lit(0)).alias("findings"))


# two bounded calls of 500, then until nothing is due, for finished analyses past a retention of 1,500 days
_DUE = f"o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '{B.ANALYSES_NOW}' - INTERVAL 1500 DAY"


@query(
    "sink_bounded_cleanup",
    f"""SELECT 'first' AS call, least(500, count(*)) AS deleted FROM orders WHERE {_DUE} UNION ALL SELECT 'second', greatest(0, least(500, count(*) - 500)) FROM orders WHERE {_DUE}
        UNION ALL SELECT 'rest', greatest(0, count(*) - 1000) FROM orders WHERE {_DUE} UNION ALL SELECT 'left', count(*) FROM orders WHERE NOT ({_DUE})
        UNION ALL SELECT 'left findings', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT ({_DUE})""",
)
def _(spark, d):
    t = stored(spark, d)
    due = (F.col("status") == "F") & (F.col("created_at") <= retention_cutoff(B.ANALYSES_NOW, 1500))
    order = [F.col("created_at"), F.col("analysis_id")]
    first, second = t.cleanup(due, order, 500, ["findings"]), t.cleanup(due, order, 500, ["findings"])
    rest = t.cleanup(due, order, None, ["findings"])  # in one change: bounded calls would rewrite all buckets for each 100,000 rows
    counts = [("first", first), ("second", second), ("rest", rest), ("left", t.read("analyses").count()), ("left findings", t.read("findings").count())]
    return spark.createDataFrame(counts, "call string, deleted long")


@query(
    "point_lookups",
    """SELECT 'user by id' AS lookup, c_custkey AS user_id, c_name AS name FROM customer WHERE c_custkey = 77 UNION ALL SELECT 'user by email', c_custkey, c_name FROM customer WHERE c_custkey = 42
       UNION ALL SELECT 'user by subject', c_custkey, c_name FROM customer WHERE sha256('s' || c_custkey) = sha256('s9') UNION ALL SELECT 'missing', c_custkey, c_name FROM customer WHERE c_custkey = -1
       UNION ALL SELECT 'reservation', o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 100 UNION ALL SELECT 'dispatch', l_orderkey, l_returnflag FROM lineitem WHERE l_orderkey = 100""",
)
def _(spark, d):
    c = B.table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        F.sha2(F.concat(F.lit("s"), F.col("c_custkey").cast("string")), 256).alias("subject"))
    users = LinkedTables(spark, shared_dir(spark, "users"), {"users": ["user_id"]}, 16, {"users": ["email", "subject"]})
    users.save(users=c)
    leases = LinkedTables(spark, shared_dir(spark, "leases"), {"reservations": ["commit_key"], "dispatches": ["commit_key"]}, 16)
    leases.save(reservations=B.table(spark, d, "orders").select(F.col("o_orderkey").alias("commit_key"), F.col("o_orderstatus").alias("status")),
                dispatches=B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_key"), F.col("l_returnflag").alias("status")))
    found = [("user by id", users.lookup("users", 77)), ("user by email", users.lookup_by("users", "email", "customer#000000042@example.org")), ("missing", users.lookup("users", -1)),
             ("user by subject", users.lookup_by("users", "subject", hashlib.sha256(b"s9").hexdigest()))]
    out = None
    for name, rows in [*found, ("reservation", leases.lookup("reservations", 100)), ("dispatch", leases.lookup("dispatches", 100))]:
        key, text = rows.columns[0], "status" if "status" in rows.columns else "name"
        part = rows.select(F.lit(name).alias("lookup"), F.col(key).alias("user_id"), F.col(text).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out
