"""Queries over folder trees and captured change lists (survey 2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.plans.registry import query
from tidewatch.session import shared_dir
from tidewatch.sources import bridge as B
from tidewatch.sources import tree

FOLDER = "CASE page_id % 9 WHEN 0 THEN 'node_modules' WHEN 1 THEN '.github' WHEN 2 THEN '.gitlab' WHEN 3 THEN 'env' WHEN 4 THEN 'environment' ELSE 'src' END"
EXTENSION = "CASE page_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.TSX' WHEN 2 THEN '.h' WHEN 3 THEN '.txt' ELSE '' END"
# the path of a page below its folder, without scheme, query and fragment
PAGE_PATH = "concat({folder}, '/', regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/f', CAST(page_id AS VARCHAR(20)), {extension})".format(folder=FOLDER, extension=EXTENSION)


@query(
    "pruned_listing",
    f"""SELECT p AS path, language, lower('.' || split_part(f, '.', -1)) AS extension, size_bytes FROM (
      SELECT {PAGE_PATH} AS p, split_part({PAGE_PATH}, '/', -1) AS f, strlen(html) AS size_bytes, page_id,
        CASE page_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'c_cpp' END AS language FROM pages)
    WHERE language IS NOT NULL AND page_id % 9 > 3 AND p IS NOT NULL""",
)
def _(spark, d):
    pages = B.table(spark, d, "pages")
    return tree.listed(pages.select(F.expr(PAGE_PATH).alias("path"), F.octet_length("html").cast("long").alias("size")))


@query(
    "staged_listing",
    f"""SELECT {PAGE_PATH} AS path, CASE page_id % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'D' WHEN 2 THEN 'R100' ELSE 'A' END AS status,
      CASE WHEN page_id % 4 = 1 THEN 'deleted' WHEN page_id % 5 < 3 THEN 'scan' ELSE 'unsupported' END AS state,
      CASE WHEN page_id % 4 <> 1 AND page_id % 5 < 3 AND page_id % 3 <> 0 THEN strlen(html) END AS content_bytes FROM pages""",
)
def _(spark, d):
    pages = B.table(spark, d, "pages").withColumn("path", F.expr(PAGE_PATH))
    status = F.expr("CASE page_id % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'D' WHEN 2 THEN 'R100' ELSE 'A' END")
    old = F.when(status == "R100", F.concat(F.lit("old/"), "path"))  # concat_ws leaves it out where there is none
    lines = pages.select(F.concat_ws("\t", status, old, "path").alias("value"))
    entries = tree.staged(lines)
    texts = tree.staged_content(entries, pages.filter("page_id % 3 <> 0").select("path", F.col("html").alias("content")))
    sizes = texts.select("path", F.octet_length("content").cast("long").alias("content_bytes"))
    return entries.join(sizes, "path", "left")


@query(
    "tree_listing",
    """SELECT DISTINCT 'year=' || year(o_orderdate) || '/status=' || o_orderstatus AS folder, 'parquet' AS language FROM orders
       WHERE o_orderstatus <> 'O' AND year(o_orderdate) >= 1995 AND year(o_orderdate) <= 1999""",
)
def _(spark, d):
    # a tree of year and status folders is written first; status=O is pruned, and so are years outside of the prefix
    root = shared_dir(spark, "tree")
    o = B.table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"))
    o.filter("year >= 1995").write.partitionBy("year", "status").parquet(root)
    files = tree.discover(spark, root, exclude=["status=O"], extensions=".parquet").filter(F.col("path").startswith("year=199"))
    return files.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder"), "language").distinct()
