"""URL verdicts: host and path rules, and boosted trees for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SAMPLE = 20000
FEATURES = ("length", "host_length", "depth", "labels", "digits", "letters", "entropy", "params", "hyphens", "longest", "secure", "fragment", "page", "suffix_rate", "suffix_share")
SUFFIX = r"([^.]*)$"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host is what follows the first :// up to /, ?, # or the
    end, A-Z lowered; path goes on to ?, # or the end."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(url, pattern, 1)
    return F.translate(host, _LOWER.upper(), _LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(out.isNotNull(), out).otherwise(F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return out


def lexical(df: DataFrame) -> DataFrame:
    """The numbers that the trees see, from url, host and path."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1))
    count = lambda s: F.regexp_count(url, F.lit(s)).cast("double")
    chars = F.array_distinct(F.split(url, ""))
    share = lambda c: (F.char_length(url) - F.char_length(F.replace(url, c))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    longest = F.array_max(F.transform(F.split(url, "[/.?&=#:-]+"), lambda x: F.char_length(x)))
    values = {
        "length": F.char_length(url), "host_length": F.char_length("host"), "depth": F.regexp_count("path", F.lit("/[^/]")), "labels": F.regexp_count("host", F.lit("[^.]+")),
        "digits": count("[0-9]") / n, "letters": count("[A-Za-z]") / n, "entropy": entropy, "params": count("[?&][^=&#]+="), "hyphens": count("[-_]"), "longest": longest,
        "secure": F.startswith(url, F.lit("https")).cast("int"), "fragment": F.contains(url, F.lit("#")).cast("int"), "page": F.col("path").rlike(r"\.[a-z]{2,5}$").cast("int"),
    }
    return df.withColumns({k: v.cast("double") for k, v in values.items()} | {"suffix": F.regexp_extract("host", SUFFIX, 1)})


def fit(df: DataFrame, sample: int = SAMPLE, trees: int = 10, depth: int = 3):
    """(vectors, model) of the trees for (url, host, path, label): a function
    that adds the column ``features``, and the model, or None where labels
    are of one kind.

    How often URLs of a suffix were blocked, and how many there are, is
    counted over all of ``df``; the trees learn from at most ``sample``
    different URLs, the first by hash."""
    suffix = F.regexp_extract("host", SUFFIX, 1)
    counts = written(df.groupBy(suffix.alias("suffix")).agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("n")))
    state = counts.agg(F.sum("blocked").alias("a"), F.sum("n").alias("n")).first()
    total, blocked = int(state["n"] or 0), float(state["a"] or 0)
    rate = blocked / max(1, total)
    suffixes = counts.select("suffix", ((F.col("blocked") + 2 * rate) / (F.col("n") + 2)).alias("suffix_rate"), (F.col("n") / max(1, total)).alias("suffix_share"))

    def vectors(x: DataFrame) -> DataFrame:
        x = lexical(x).join(suffixes, "suffix", "left").fillna({"suffix_rate": rate, "suffix_share": 0.0})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(x)

    if not 0 < blocked < total:
        return vectors, None
    known = df.groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.max("label").alias("label"))
    known = written(known.orderBy(F.xxhash64("url"), "url").limit(sample))
    return vectors, GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxMemoryInMB=128).fit(vectors(known).select("features", "label"))


def labelled(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, hit): hit is the rule's struct or null."""
    host, path = parts(F.col("url"))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    return df.withColumn("hit", rule_of(F.col("host"), F.col("path")))


def judge(pages: DataFrame, sample: int = SAMPLE, trees: int = 10, depth: int = 3) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict and
    block_score.

    A rule fits its host and all below it where the path starts with the
    rule's; the longest wins and gives the verdict.  The URLs that rules judge
    are the labels of gradient-boosted trees over lexical features and over
    how often URLs with the same suffix were blocked (see ``fit``).  The trees
    judge the rest: block where they find it likelier.

    Null URLs and URLs without :// have an empty host and path; no rule fits
    them.  Repeated URLs are learnt once, and count in the suffixes as often
    as they stand.  Nulls in page_id stay; other columns are ignored; an empty
    table gives an empty result.  Where rules give fewer than two kinds of
    labels, the rest is allowed (score 0)."""
    df = labelled(pages)
    label = (F.col("hit.verdict") == "block").cast("double")
    vectors, model = fit(df.where("hit is not null").select("url", "host", "path", label.alias("label")), sample, trees, depth)
    score = F.lit(0.0)
    if model:
        df, score = model.transform(vectors(df)), vector_to_array("probability")[1]
    verdict = F.coalesce(F.col("hit.verdict"), F.when(score > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return df.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), score.alias("block_score"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every url of pages; see the contract of op10."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("block_score")
