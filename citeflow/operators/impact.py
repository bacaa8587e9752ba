"""Author impact: metrics, h- and g-index, rankings, inequality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeflow.functions import text as T

RANKINGS = {"total": "total_citations", "avg": "avg_citations", "articles": "n_articles", "h": "h_index", "g": "g_index"}


def explode_authors(works: DataFrame, separator: str = ",", missing: str | None = None) -> DataFrame:
    """(work_id, author, cites): a row per author part; works without author
    go unless ``missing`` names them."""
    author = F.col("author") if missing is None else F.coalesce("author", F.lit(missing))
    return works.where(author.isNotNull()).select("work_id", F.explode(T.authors(author, separator)).alias("author"), "cites")


def author_metrics(works: DataFrame, separator: str = ",", missing: str | None = None) -> DataFrame:
    """Per author: n_articles, total_citations, avg_citations, h_index,
    g_index.  Missing citations count 0; an author named twice in a work
    counts twice.  Citations are counted by value before they are gathered,
    so what an author holds grows with distinct values, not with works."""
    cites = F.coalesce("cites", F.lit(0)).cast("long")
    rows = explode_authors(works, separator, missing).select("author", cites.alias("c"))
    by_value = rows.groupBy("author", "c").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("author").orderBy(F.desc("c"))
    run = by_value.withColumns({"seen": F.sum("k").over(w), "sum": F.sum(F.col("k") * F.col("c")).over(w)})
    # inside a run of k equal values c the i-th rank is seen - k + i
    before, summed = F.col("seen") - F.col("k"), F.col("sum") - F.col("k") * F.col("c")
    h = F.when(F.col("c") > before, F.least("c", "seen")).otherwise(0)
    # the last g in (before, seen] with summed + (g - before) * c >= g * g
    root = F.floor((F.col("c") + F.sqrt(F.col("c") * F.col("c") + 4.0 * F.greatest(summed - before * F.col("c"), F.lit(0)))) / 2)
    ok = lambda g: (g > before) & (g <= F.col("seen")) & (summed + (g - before) * F.col("c") >= g * g)
    pick = F.least(root + 1, F.col("seen"))
    g = F.when(ok(pick), pick).when(ok(pick - 1), pick - 1).when(ok(pick - 2), pick - 2).otherwise(0)
    run = run.withColumns({"h": h, "g": g})
    return run.groupBy("author").agg(F.sum("k").alias("n_articles"), F.sum(F.col("k") * F.col("c")).alias("total_citations"), F.max("h").cast("long").alias("h_index"), F.max("g").cast("long").alias("g_index")).withColumn("avg_citations", F.col("total_citations").cast("double") / F.col("n_articles"))


def top_authors(metrics: DataFrame, by: str, n: int = 10) -> DataFrame:
    column = RANKINGS[by]
    return metrics.select("author", column).orderBy(F.desc(column), "author").limit(n)


def authors_over(metrics: DataFrame, least: int = 100) -> DataFrame:
    return metrics.where(F.col("total_citations") > least)


def lorenz(metrics: DataFrame) -> DataFrame:
    """Points (author_share, citation_share) by ascending total citations;
    none if nobody is cited.  Authors are counted by total first, so the
    ordered window runs over distinct totals."""
    by = metrics.groupBy(F.col("total_citations").alias("t")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.orderBy("t")
    by = by.withColumns({"seen": F.sum("k").over(w), "cum": F.sum(F.col("k") * F.col("t")).over(w)})
    ends = by.agg(F.max("seen").alias("n"), F.max("cum").alias("all"))
    by = by.join(F.broadcast(ends), F.col("all") > 0)
    each = by.select("t", "k", "seen", "cum", "n", "all", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("i"))
    return each.select(((F.col("seen") - F.col("k") + F.col("i")).cast("double") / F.col("n")).alias("author_share"), ((F.col("cum") - (F.col("k") - F.col("i")) * F.col("t")).cast("double") / F.col("all")).alias("citation_share"))


def gini(metrics: DataFrame) -> DataFrame:
    """One row: the Gini coefficient of total citations."""
    by = metrics.groupBy(F.col("total_citations").alias("t")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.orderBy("t")
    by = by.withColumns({"cum": F.sum(F.col("k") * F.col("t")).over(w)})
    # k equal totals t after a sum s add k * s + t * k * (k + 1) / 2
    part = F.col("k") * (F.col("cum") - F.col("k") * F.col("t")) + F.col("t") * F.col("k") * (F.col("k") + 1) / 2
    one = by.agg(F.sum("k").alias("n"), F.sum(part).alias("s"), F.max("cum").alias("c"))
    return one.select(((F.col("n") + 1 - F.try_divide(2 * F.col("s"), F.col("c"))) / F.col("n")).cast("double").alias("gini"))
