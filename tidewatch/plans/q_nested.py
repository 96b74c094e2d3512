"""Nested JSON queries (survey 2.3, 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import nested as N
from tidewatch.plans.registry import query
from tidewatch.sources import bridge as B


def _payload(depth: int, raw: bool) -> str:
    """A payload of the given depth as an SQL expression; ``raw`` with the fields that hold source."""
    text = '{"code":"print(1)","id":@,"note":"a \\"code\\": b"}' if raw else '{"id":@,"note":"a \\"code\\": b"}'
    for i in range(depth - 1):
        if i % 2:
            text = '[' + text + (',{"full_source":{"z":[1,2]},"v":null}' if raw else ',{"v":null}') + ',"code"]'
        else:
            text = '{"in":' + text + (',"raw_source":["x",{"y":1}]' if raw else '') + ',"only":' + ('{"raw_code":1}' if raw else '{}') + '}'
    return "'" + text.replace("@", "' || event_id || '") + "'"


def _payloads(raw: bool) -> str:
    return "CASE event_id % 8 " + " ".join(f"WHEN {d} THEN {_payload(d, raw)}" for d in range(1, 7)) + (" WHEN 0 THEN '{\"code\":' END" if raw else " END")


@query("json_key_strip", f"SELECT event_id, {_payloads(False)} AS payload FROM events")
def _(spark, d):
    rows = B.table(spark, d, "events").withColumn("payload", F.expr(_payloads(True).replace('\\"', '\\\\"')))
    return N.strip_keys(rows.select("event_id", "payload"), "payload")


_SUMMARY = """CASE event_type WHEN 'click' THEN '{"_repository":{"owner":"o' || user_id || '","repository":"r"},"n":1}' WHEN 'view' THEN '{"_repository":"text/' || user_id || '"}'
  WHEN 'signup' THEN '{"_repository":{"owner":"o' || user_id || '"}}' WHEN 'error' THEN '{"_repository":[1]}' ELSE '{broken' END"""


@query(
    "repository_of_summary",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'o' || user_id || '/r' WHEN 'view' THEN 'text/' || user_id WHEN 'signup' THEN 'o' || user_id ELSE '' END AS repository, "
    "CASE WHEN event_type = 'click' THEN CAST(floor(value) AS INT) ELSE 0 END AS n FROM events",
)
def _(spark, d):
    t = F.col("event_type")
    number = F.when(t == "click", F.floor("value").cast("string")).when(t == "view", "n/a").when(t == "signup", "")
    rows = B.table(spark, d, "events").select("event_id", F.expr(_SUMMARY).alias("summary"), number.alias("number"))
    return rows.select("event_id", N.repository_name("summary").alias("repository"), N.int_or("number").alias("n"))
