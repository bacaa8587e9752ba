"""Bibliographic views over the driver's star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def works(spark: SparkSession, d: str) -> DataFrame:
    """Orders as works: suppliers are authors, parts are references."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))), ", ").alias("author"),
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("W"), F.col("l_partkey").cast("string")))), "; ").alias("refs"),
    )
    k = F.col("o_orderkey")
    return orders.join(lines, "o_orderkey", "left").select(
        k.alias("work_id"),
        F.concat(F.lit("Order "), k.cast("string")).alias("title"),
        "author",
        "refs",
        F.when(k % 17 != 0, F.year("o_orderdate")).cast("double").alias("pub_year"),
        F.when(k % 13 == 0, None).when(k % 11 == 0, 0.0).otherwise(F.floor(F.col("o_totalprice") / 1000)).cast("double").alias("cites"),
    )


WORKS = """works AS (
  SELECT o_orderkey AS work_id, 'Order ' || o_orderkey AS title, li.author, li.refs,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(year(o_orderdate) AS DOUBLE) END AS pub_year,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE floor(o_totalprice / 1000) END AS cites
  FROM orders LEFT JOIN (
    SELECT l_orderkey, array_to_string(list_sort(list_distinct(list('S' || l_suppkey))), ', ') AS author,
      array_to_string(list_sort(list('W' || l_partkey)), '; ') AS refs
    FROM lineitem GROUP BY 1) li ON o_orderkey = l_orderkey)"""


def markers(spark: SparkSession, d: str) -> DataFrame:
    """Events as marker rows: sign-ups open articles, others name models."""
    e = spark.read.parquet(f"{d}/events.parquet")
    title = F.concat(F.lit("article "), F.col("user_id").cast("string"), F.lit(" "), (2000 + F.col("event_id") % 25).cast("string"))
    model = F.concat(F.lit("M"), F.floor(F.col("value") / 10).cast("string"))
    return e.select(F.col("event_id").alias("row_id"), F.when(F.col("event_type") == "signup", "Title").when(F.col("event_type") == "purchase", " SIM ").otherwise("no").alias("status"), F.when(F.col("event_type") == "signup", title).otherwise(model).alias("data"))


MODELS = """ev AS (
  SELECT event_id, event_type = 'signup' AS is_title,
    CASE WHEN event_type = 'signup' THEN 'article ' || user_id || ' ' || (2000 + event_id % 25) ELSE 'M' || CAST(floor(value / 10) AS BIGINT) END AS data,
    event_type = 'purchase' AS used FROM events),
carried AS (
  SELECT *, last_value(CASE WHEN is_title THEN event_id END IGNORE NULLS) OVER w AS mark,
    last_value(CASE WHEN is_title THEN data END IGNORE NULLS) OVER w AS article
  FROM ev WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
models AS (
  SELECT mark, article, data AS model, used, CAST(regexp_extract(article, '(19|20)\\d{2}') AS INTEGER) AS year
  FROM carried WHERE NOT is_title AND article IS NOT NULL AND data IS NOT NULL)"""


def named_markers(spark: SparkSession, d: str) -> DataFrame:
    """The marker rows with model names in several spellings, some invalid."""
    n = F.pmod(F.substring("data", 2, 9).cast("int"), F.lit(8))
    names = F.array(*(F.lit(x) for x in NAMES))
    return markers(spark, d).withColumn("data", F.when(F.col("status") == "Title", F.col("data")).otherwise(F.get(names, n)))


NAMES = ("Balanced Scorecard (BSC)", "bpmm", "SCOR", "Framework - own", "Matrix", "SMART System / Performance Pyramid", "Not valid CSV text", "framework -x")
_NAMED = "[" + ", ".join(f"'{x}'" for x in NAMES) + "][CAST(floor(value / 10) AS BIGINT) % 8 + 1]"
NAMED = MODELS.replace("'M' || CAST(floor(value / 10) AS BIGINT)", _NAMED).replace("data AS model, used", "CASE WHEN lower(data) LIKE 'framework -%' THEN 'Framework' ELSE data END AS model, used").replace("data IS NOT NULL)", "data IS NOT NULL AND lower(data) <> 'not valid csv text')")
