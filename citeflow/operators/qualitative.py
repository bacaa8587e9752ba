"""Models named in articles, from an ordered stream of marker rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeflow.functions import text as T

SPAN = 1 << 16
# The groups of article_lists and the spellings they cover.
GROUPS = {
    "BSC": ["Balanced Scorecard (BSC)"],
    "Performance Pyramid": ["SMART System / Performance Pyramid"],
    "Frameworks": ["Framework"],
    "BPMM": ["BPMM"],
    "SCOR": ["SCOR"],
    "Matrix": ["Matrix"],
}


def ffill_article(markers: DataFrame) -> DataFrame:
    """(row_id, mark, status, data): every row with the title row before it.

    The carry runs inside spans of row ids; a table of one row per span
    carries the last title over, so no window sees all rows."""
    status = F.lower(T.strip(F.coalesce("status", F.lit(""))))
    rows = markers.select("row_id", status.alias("status"), T.strip(F.coalesce("data", F.lit(""))).alias("data"), F.floor(F.col("row_id") / SPAN).alias("span"))
    title = F.when(F.col("status") == "title", F.struct(F.col("row_id").alias("mark"), F.col("data").alias("article")))
    rows = rows.withColumn("title", title)
    ends = rows.where("title is not null").groupBy("span").agg(F.max("title").alias("end"))
    spans = rows.select("span").distinct().join(ends, "span", "left")
    spans = spans.select("span", F.last("end", True).over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    own = F.last("title", True).over(Window.partitionBy("span").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("own", own).join(spans, "span")
    now = F.coalesce("own", "carried")
    return rows.select("row_id", "status", "data", now["mark"].alias("mark"), now["article"].alias("article"))


def models(markers: DataFrame) -> DataFrame:
    """(mark, article, model, used, year) for every usable marker row."""
    rows = ffill_article(markers).where("status <> 'title' and article <> '' and data <> ''")
    model = F.when(F.startswith(F.lower("data"), F.lit("framework -")), F.lit("Framework")).otherwise(F.col("data"))
    rows = rows.where(F.lower("data") != "not valid csv text")
    return rows.select("mark", "article", model.alias("model"), F.col("status").isin("yes", "sim", "y").alias("used"), T.year_in(F.col("article")).alias("year"))


def articles_without_models(markers: DataFrame) -> DataFrame:
    """Titles whose marker is followed by no model row at all."""
    rows = ffill_article(markers)
    titles = rows.where("status = 'title' and article <> ''").select("mark", "article")
    return titles.join(rows.where("status <> 'title' and data <> ''").select("mark").distinct(), "mark", "left_anti").select("mark", "article")


def counted(found: DataFrame, used: bool) -> DataFrame:
    return found.where(F.col("used") == used).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def model_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("model").agg(F.count_if(~F.col("used")).alias("citations"), F.count_if("used").alias("uses"))


def compared(found: DataFrame, how: str) -> DataFrame:
    test = {"only_used": "citations = 0 and uses > 0", "only_cited": "uses = 0 and citations > 0", "used_gt_cited": "uses > citations", "cited_gt_used": "citations > uses"}[how]
    return model_summary(found).where(test)


def cited_bar(found: DataFrame, markers: DataFrame, least: int = 5) -> DataFrame:
    """Cited models with ``least`` or more; the others, and articles without
    models, as one bar each where there are any."""
    n = counted(found, False)
    big = n.where(F.col("n") >= least)
    rest = n.where(F.col("n") < least).agg(F.lit("Other models").alias("model"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    none = articles_without_models(markers).agg(F.lit("Articles without models").alias("model"), F.count(F.lit(1)).alias("n"))
    return big.unionByName(rest.where("n > 0")).unionByName(none.where("n > 0"))


def recent_models(found: DataFrame, as_of_year: int, years: int = 5) -> DataFrame:
    return counted(found.where(F.col("year").between(as_of_year - years + 1, as_of_year)), False)


def yearly(found: DataFrame, used: bool, more_than: int = 10) -> DataFrame:
    """(year, model, n) of models with more than so many dated rows."""
    rows = found.where((F.col("used") == used) & F.col("year").isNotNull())
    popular = rows.groupBy("model").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > more_than).select("model")
    return rows.join(popular, "model", "left_semi").groupBy("year", "model").agg(F.count(F.lit(1)).alias("n"))


def yearly_total(found: DataFrame, more_than: int = 20) -> DataFrame:
    """All dated rows; models with more than so many, or all if none has."""
    rows = found.where("year is not null").groupBy("year", "model").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("model").agg(F.sum("n").alias("k"))
    any_ = totals.agg(F.coalesce(F.max("k"), F.lit(0)).alias("most"))
    kept = totals.join(F.broadcast(any_), (F.col("k") > more_than) | (F.col("most") <= more_than)).select("model")
    return rows.join(kept, "model", "left_semi").select("year", "model", "n")


def pivoted(long: DataFrame, names: list[str]) -> DataFrame:
    """Years by the named models, 0 where there is nothing."""
    return long.groupBy("year").pivot("model", names).agg(F.sum("n")).na.fill(0)


def article_lists(found: DataFrame, groups: dict[str, list[str]] = GROUPS) -> DataFrame:
    """(grp, article, model, used), distinct and by article: what is named of
    each group of model spellings, in any case."""
    key = F.create_map(*(F.lit(x) for g, names in groups.items() for n in names for x in (n.lower(), g)))
    rows = found.select(F.try_element_at(key, F.lower("model")).alias("grp"), "article", "model", "used")
    return rows.where("grp is not null").distinct().orderBy("grp", "article", "model", "used")
