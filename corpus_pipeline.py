"""From raw documents to a mixed training set, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from citeflow.llm.shared import checked, whole, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.  Null and empty
    texts have the lowest score; repeated rows go or stay together; all
    columns pass through; an empty table stays empty."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from the texts; every document stays, repeated rows
    as one document, null texts as they are."""
    return line_dedup.drop_recurring(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id stays, and of its
    rows one, the first by a hash of the text.  Documents without words, which
    are linked with nothing, stay.  Rows without doc_id are linked like
    others, after all that have one."""
    most = docs.agg(F.max("doc_id")).first()[0]
    spare = F.pmod(F.xxhash64("text"), F.lit(1 << 61)) + F.lit(min(most or 0, 1 << 61) + 1)
    me = F.coalesce("doc_id", spare)
    found = ngram_join.join(docs.select(me.alias("doc_id"), "text"))
    state = found.where("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("component_id").alias("component_id"))
    state = written(state.where("component_id <> doc_id or rows > 1").select(F.col("doc_id").alias("id"), (F.col("component_id") == F.col("doc_id")).alias("first")))
    said = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    keyed = whole(docs, me.alias("id"), F.xxhash64("text").alias("key"), said.alias("said")).join(checked(state), "id", "left")
    kept = keyed.where("first is null or not said").select("row")
    if state.where("first").limit(1).count():  # rows that share the doc_id that stays
        first = F.min_by("row", F.struct("key", F.xxhash64(F.to_json("row"))))
        kept = kept.union(keyed.where("first and said").groupBy("id").agg(first.alias("row")).select("row"))
    return kept.select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; null and empty texts stay,
    repeated rows go or stay together."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each copy, with its shard
    and its order inside it.  Null and empty texts are never taken; repeated
    rows are taken as documents of their own."""
    out = mixing.mix(docs).where("mix_copies > 0")
    out = out.select(*docs.columns, "mix_order", F.posexplode("mix_shards").alias("mix_copy", "mix_shard"))
    return out.select(*docs.columns, "mix_copy", "mix_shard", "mix_order")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", one_of_each),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: The toxicity model and the template tree have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
