"""Filling missing fields from a snapshot of a works catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.functions import text as T

FIELDS = ("author", "pub_year", "cites", "publisher", "refs")


def needs_enrichment(fields=("cites", "refs")):
    """A work with a title but no DOI, or without one of the fields; only
    text fields can be missing by being blank."""
    missing = [T.blank(F.col(f)) if f in ("author", "publisher", "refs") else F.col(f).isNull() for f in fields]
    need = T.blank(F.col("doi")) & F.col("title").isNotNull()
    for m in missing:
        need = need | m
    return need


def title_key(c):
    return F.lower(F.regexp_replace(T.strip(c), r"(?U)\s+", " "))


def fresh(snapshot: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Cached answers no older than so many days."""
    return snapshot.where(F.col("fetched_at") >= F.lit(as_of) - F.expr(f"interval {days} days"))


def flat(snapshot: DataFrame) -> DataFrame:
    """The snapshot's nested records as works columns, one row per DOI: the
    smallest by title, combined before the shuffle."""
    rows = snapshot.select(T.doi(F.col("doi")).alias("key"), title_key(F.col("title")).alias("title_key"), T.author_names(F.col("authorships")).alias("new_author"), F.col("publication_year").cast("double").alias("new_pub_year"), F.col("cited_by_count").cast("double").alias("new_cites"), F.col("primary_location.source.host_organization_name").alias("new_publisher"), T.work_ids(F.col("referenced_works")).alias("new_refs"))
    values = [c for c in rows.columns if c.startswith("new_")]
    best = F.min(F.struct("title_key", *values)).alias("best")
    return rows.where("key is not null and key <> ''").groupBy("key").agg(best).select("key", *(F.col(f"best.{c}").alias(c) for c in values))


def fill_missing_doi(works: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Blank DOIs from the smallest DOI with the same normalised title."""
    known = snapshot.select(title_key(F.col("title")).alias("k"), T.doi(F.col("doi")).alias("found")).where("k <> '' and found <> ''").groupBy("k").agg(F.min("found").alias("found"))
    # only works that lack a DOI and have a title meet the snapshot
    want = T.blank(F.col("doi")) & (F.coalesce(title_key(F.col("title")), F.lit("")) != "")
    rest = works.where(~want).withColumn("doi", F.when(~T.blank(F.col("doi")), F.col("doi")))
    out = works.where(want).withColumn("k", title_key(F.col("title"))).join(known, "k", "left")
    return out.withColumn("doi", F.col("found")).select(*works.columns).unionByName(rest)


def enrich(works: DataFrame, snapshot: DataFrame, fields=FIELDS) -> DataFrame:
    """Works with missing fields filled by DOI and ``missed``, the requested
    fields that stay empty.  What is there is never overwritten; a field that
    the works table lacks is added."""
    kinds = {"pub_year": "double", "cites": "double"}
    works = works.withColumns({f: F.lit(None).cast(kinds.get(f, "string")) for f in fields if f not in works.columns})
    # only works that have a DOI and miss something meet the snapshot
    gap = F.lit(False)
    for f in fields:
        gap = gap | T.blank(F.col(f))
    want = gap & (F.coalesce(T.doi(F.col("doi")), F.lit("")) != "")
    found = flat(snapshot)
    new = [c for c in found.columns if c != "key"]
    met = works.where(want).withColumn("key", T.doi(F.col("doi"))).join(found, "key", "left").drop("key")
    alone = works.where(~want).select("*", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in new))
    out = met.unionByName(alone)
    have = {f: F.coalesce(F.when(~T.blank(F.col(f)), F.col(f)), F.col(f"new_{f}")) for f in fields}
    out = out.withColumns(have)
    missed = F.filter(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return out.withColumn("missed", missed).select(*works.columns, "missed")


def audit(enriched: DataFrame) -> DataFrame:
    """(work_id, doi, missed) of works that still miss something."""
    return enriched.where(F.size("missed") > 0).select("work_id", "doi", "missed")
