"""Science mapping: references, co-citation, coupling, co-words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.functions import text as T

# The public English stop list of the NLTK corpora, whole.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself "
    "it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same "
    "so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't "
    "haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

#: References of one work above which their pairs are dealt out, and works of
#: a reference that meet each other in one task.
LONG_LIST, BLOCK = 4096, 4096


def clean_refs(works: DataFrame) -> DataFrame:
    """(work_id, ref): cleaned references, duplicates kept."""
    return works.where("refs is not null").select("work_id", F.explode(T.references(F.col("refs"))).alias("ref"))


def ref_summary(works: DataFrame) -> DataFrame:
    n = F.sum(F.coalesce(F.size(T.references(F.col("refs"))), F.lit(0)))
    without = F.count_if(F.col("refs").isNull())
    return works.agg(F.coalesce(n, F.lit(0)).cast("long").alias("total_refs"), F.count("refs").alias("with_refs"), without.alias("without_refs"), F.try_divide(100.0 * without, F.count(F.lit(1))).alias("percent_without"))


def co_citation(works: DataFrame) -> DataFrame:
    """(ref1, ref2, n): pairs of distinct references of a work, ref1 < ref2,
    by the number of works.  Pairs are made inside each work's own list, so
    no join moves the references; a row for each first reference is dealt out
    where a list is long."""
    refs = works.where("refs is not null").select(F.array_sort(F.array_distinct(T.references(F.col("refs")))).alias("r"))
    first = refs.select("r", F.posexplode("r").alias("i", "ref1"))
    pairs = lambda x: x.select("ref1", F.explode(F.slice("r", F.col("i") + 2, F.size("r"))).alias("ref2"))
    long_ = refs.where(F.size("r") > LONG_LIST).select("r", F.posexplode("r").alias("i", "ref1")).select("ref1", F.slice("r", F.col("i") + 2, F.size("r")).alias("r"), F.lit(-1).alias("i")).repartition("ref1")
    return pairs(first.where(F.size("r") <= LONG_LIST)).union(pairs(long_)).groupBy("ref1", "ref2").agg(F.count(F.lit(1)).alias("n"))


def coupling(works: DataFrame) -> DataFrame:
    """(work1, work2, shared): works that share references, by how many.

    A reference of many works falls apart into parts of about BLOCK works;
    every two parts meet once, so the pairs of a hot reference are spread over
    tasks.  The result has a row for every pair that shares a reference: it
    is that large by definition."""
    refs = clean_refs(works).distinct()
    parts = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    refs = refs.join(refs.groupBy("ref").agg(parts.alias("parts"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "ref")
    refs = refs.withColumn("part", F.pmod(F.xxhash64("work_id"), "parts").cast("int"))
    refs = refs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    refs = refs.select("ref", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "work_id")
    a, b = refs.where("part = i").alias("a"), refs.where("part = j").alias("b")
    same = (F.col("a.ref") == F.col("b.ref")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    pairs = a.join(b, same & ((F.col("a.i") < F.col("a.j")) | (F.col("a.work_id") < F.col("b.work_id"))))
    ends = (F.least("a.work_id", "b.work_id").alias("work1"), F.greatest("a.work_id", "b.work_id").alias("work2"))
    return pairs.select(*ends).groupBy("work1", "work2").agg(F.count(F.lit(1)).alias("shared"))


def top_pairs(pairs: DataFrame, n: int) -> DataFrame:
    a, b, k = pairs.columns
    return pairs.orderBy(F.desc(k), a, b).limit(n)


def graph(pairs: DataFrame, n: int = 100) -> DataFrame:
    """(src, dst, weight): the n strongest pairs."""
    a, b, k = pairs.columns
    return top_pairs(pairs, n).select(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"), F.col(k).cast("double").alias("weight"))


def coword(docs: DataFrame, focus: str, fields: list[str], stopwords=STOPWORDS) -> DataFrame:
    """(word, n): documents that hold ``focus`` as a substring, by their other
    alphabetic words."""
    focus = focus.lower()
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in fields)))
    tokens = F.filter(F.array_distinct(F.split(text, r"(?U)\s+")), lambda w: w.rlike(r"^\p{L}+$") & (w != focus) & ~w.isin(*stopwords))
    rows = docs.select(text.alias("t"), tokens.alias("w")).where(F.contains("t", F.lit(focus)))
    return rows.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def coword_top(words: DataFrame, n: int = 20) -> DataFrame:
    return words.orderBy(F.desc("n"), "word").limit(n)


def coword_graph(top: DataFrame, focus: str) -> DataFrame:
    """The star: (src, dst, weight, size) with size 10 + count."""
    return top.select(F.lit(focus.lower()).alias("src"), F.col("word").alias("dst"), F.col("n").alias("weight"), (10 + F.col("n")).alias("size"))


def field_summary(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, present, missing, percent_missing) for each field."""
    counts = docs.agg(F.count(F.lit(1)).alias("all"), *(F.count(F.col(f)).alias(f"n_{i}") for i, f in enumerate(fields)))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"n_{i}").alias("present"), (F.col("all") - F.col(f"n_{i}")).alias("missing"), F.try_divide(100.0 * (F.col("all") - F.col(f"n_{i}")), F.col("all")).alias("percent_missing")) for i, f in enumerate(fields)))
    return counts.select(F.inline(rows))
