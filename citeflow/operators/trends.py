"""Yearly trends, header figures and the audit of missing data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import impact


def header_metrics(works: DataFrame) -> DataFrame:
    """Unique authors, total citations, mean over works with citations."""
    people = impact.explode_authors(works).agg(F.countDistinct("author").alias("unique_authors"))
    cites = works.agg(F.coalesce(F.sum("cites"), F.lit(0.0)).cast("long").alias("total_citations"), F.avg("cites").alias("avg_citations"))
    return people.join(F.broadcast(cites), F.lit(True))


def _dated(works: DataFrame) -> DataFrame:
    return works.where("pub_year is not null").withColumn("year", F.col("pub_year").cast("int"))


def articles_per_year(works: DataFrame) -> DataFrame:
    return _dated(works).groupBy("year").agg(F.count(F.lit(1)).alias("n_articles")).orderBy("year")


def pubs_cites_by_year(works: DataFrame) -> DataFrame:
    return _dated(works).groupBy("year").agg(F.count(F.lit(1)).alias("n_articles"), F.coalesce(F.sum("cites"), F.lit(0.0)).alias("citations")).orderBy("year")


def avg_cites_by_year(works: DataFrame) -> DataFrame:
    """Citations over all articles of the year, cited or not."""
    return pubs_cites_by_year(works).select("year", F.try_divide("citations", "n_articles").alias("avg_citations"))


def uncited_by_year(works: DataFrame) -> DataFrame:
    return _dated(works).where("cites is null or cites = 0").groupBy("year").agg(F.count(F.lit(1)).alias("n_uncited")).orderBy("year")


def most_cited(works: DataFrame, least: float = 100) -> DataFrame:
    return works.where(F.col("cites") > least).select("title", "pub_year", "cites").orderBy(F.asc_nulls_last("pub_year"), F.desc("cites"), "title")


def missing_citations(works: DataFrame) -> DataFrame:
    return works.where("cites is null").select("title", "pub_year")


def missing_summary(works: DataFrame) -> DataFrame:
    n = F.count_if(F.col("cites").isNull())
    return works.agg(n.alias("n_missing"), F.coalesce(F.try_divide(100.0 * n, F.count(F.lit(1))), F.lit(0.0)).alias("percent_missing"))


def preview(works: DataFrame, n: int = 7) -> DataFrame:
    return works.orderBy("work_id").limit(n)


def missing_columns(df: DataFrame, wanted: set[str]) -> set[str]:
    return set(wanted) - set(df.columns)
