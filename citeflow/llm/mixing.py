"""Mixing sources to target weights with a splitting tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checked, whole, written

#: Blocks of a source at most, words of a block at least, blocks of all
#: sources (beside one for each), and sources whose quotas one task splits.
BLOCKS, BLOCK_WORDS, ALL_BLOCKS, GROUP = 4096, 4096, 65536, 4096
SHARDS, SEED = 16, 20240611


def word_count(column: str = "text") -> Column:
    """Number of runs of characters outside U+0020 and U+0009..U+000D."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def even(total: int, shards: int) -> np.ndarray:
    """``total`` halved down to ``shards`` parts of even size."""
    if shards == 1:
        return np.array([total], np.int64)
    half = shards // 2
    left = total * half // shards
    return np.concatenate((even(left, half), even(total - left, shards - half)))


def split_tree(quotas: np.ndarray, totals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows, of ``totals``).

    The root holds the quotas; a node gives its left half of the shards a
    multivariate hypergeometric draw of its blocks, and the rest to the
    right: exact quotas, and any block may reach any shard."""
    if len(totals) == 1:
        return quotas[None, :]
    half = len(totals) // 2
    left = rng.multivariate_hypergeometric(quotas, int(totals[:half].sum()), method="marginals")
    return np.vstack((split_tree(left, totals[:half], rng), split_tree(quotas - left, totals[half:], rng)))


def row_hash(docs: DataFrame, seed: int) -> Column:
    """A hash of all columns: rows with the same one are alike."""
    maps = {f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()}
    return F.xxhash64(F.lit(seed), *(F.to_json(F.struct(F.col(f"`{c}`"))) if c in maps else F.col(f"`{c}`") for c in docs.columns))


def source_table(sizes: DataFrame, weights, share: float, most: float) -> DataFrame:
    """(source, s, n, target, blocks), written, from (source, n): s counts the
    sources by code point, null last; they take ``weights`` in turn.

    A target is the least of level * weight and ``most`` times the size; the
    level rises until the targets add up to ``share`` of all words.  Sources
    are ranked in ranges and only sums reach the driver."""
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("source").isNull(), F.col("source"))
    ranged = written(sizes.repartitionByRange(parts, *order).withColumn("p", F.spark_partition_id()))
    before = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("k")).select("p", (F.sum("k").over(Window.orderBy("p")) - F.col("k")).alias("before"))
    s = F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy(*order)) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("s", F.lit(len(weights))) + 1).cast("int"))
    ranged = written(ranged.join(before, "p").select("source", s.alias("s"), "n").withColumn("w", weight))

    words = int(ranged.agg(F.sum("n")).first()[0] or 0)
    most_words, level, full = F.lit(float(most)) * F.col("n"), 0.0, -1
    while True:
        over = (most_words <= F.lit(level) * F.col("w")) | (F.col("n") == 0)
        state = ranged.agg(F.count_if(over).alias("k"), F.sum(F.when(over, most_words)).alias("a"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        if state["k"] == full or not state["w"]:
            break
        full, level = state["k"], (share * words - (state["a"] or 0.0)) / state["w"]
    target = F.when(over, most_words).otherwise(F.lit(level) * F.col("w"))
    size = max(BLOCK_WORDS, words // ALL_BLOCKS)
    blocks = F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.floor(F.col("n") / size))).cast("int")
    return written(ranged.select("source", "s", "n", target.alias("target"), blocks.alias("blocks")))


def shard_ends(drawn: DataFrame, shards: int, seed: int) -> DataFrame:
    """(s, ends) from (s, q): where each shard's share of a source's q draws
    ends.  Sources are split in groups, and the groups' sums by the driver: a
    draw from a group's sum and then inside it is a draw from all."""
    drawn = drawn.select(F.floor(F.col("s") / GROUP).alias("g"), "s", "q")
    sums = drawn.groupBy("g").agg(F.sum("q").alias("q")).orderBy("g").collect()
    quotas = np.array([r["q"] for r in sums], np.int64)
    shares = split_tree(quotas, even(int(quotas.sum()), shards), np.random.default_rng(seed)) if len(sums) else np.zeros((shards, 0), np.int64)
    totals = drawn.sparkSession.createDataFrame([(r["g"], shares[:, i].tolist()) for i, r in enumerate(sums)], "g long, totals array<long>")

    def split(table: pa.Table) -> pa.Table:
        table = table.sort_by("s")
        rng = np.random.default_rng([seed, table["g"][0].as_py()])
        own = split_tree(table["q"].to_numpy(), np.array(table["totals"][0].as_py(), np.int64), rng)
        return pa.table({"s": table["s"], "ends": pa.array(list(np.cumsum(own, 0).T), pa.list_(pa.int64()))})

    return drawn.join(totals, "g").groupBy("g").applyInArrow(split, "s long, ends array<long>")


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, taken, copies (how often the
    mix takes the document), shards (the output shard of each copy) and order
    (in a shard) added, each prefixed with mix_.

    Sources stand by code point, null last, and take ``weights`` in turn.  A
    source's documents fall by hash into blocks; whole passes over the source
    and then a permuted draw of its blocks fill its target, the last block up
    to the document that comes nearest.  Blocks go to shards by ``split_tree``
    and keep a hashed order inside them.  Everything is a function of the
    rows, so reruns agree.  The plan has at most BLOCKS rows a source and
    ALL_BLOCKS beside one for each source; it is broadcast while it has few
    rows (see ``checked``) and joined otherwise.

    Null texts have size 0 and are never taken; nulls in other columns don't
    matter.  Of rows that repeat another whole as many are taken as come
    nearest to the target.  Columns that are named like an added one are
    replaced; any other name passes through.  An empty table gives an empty
    result."""
    sized = whole(docs, F.col("source").alias("source"), word_count().alias("size"), row_hash(docs, seed).alias("h"))
    slim = written(sized.select("source", "size", "h"))
    sources = source_table(slim.groupBy("source").agg(F.sum("size").alias("n")), weights, share, most)

    if int(sources.agg(F.sum(F.length("source"))).first()[0] or 0) < 4 << 20:
        sources = checked(sources)

    def place(rows: DataFrame) -> DataFrame:
        out = rows.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).drop("source")
        return out.withColumn("b", F.pmod("h", "blocks").cast("int"))

    # blocks in permuted order within their source, and the words before each
    blocks = place(slim).groupBy("s", "b").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("n").alias("n"))
    order = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed), "s", "b"), "b")
    passes = F.floor(F.col("target") / F.greatest("n", F.lit(1)) + 1e-12).cast("int")
    blocks = blocks.withColumns({"rank": F.row_number().over(order) - 1, "before": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"), "all": F.count(F.lit(1)).over(Window.partitionBy("s")), "passes": passes})
    blocks = written(blocks.withColumn("rest", F.col("target") - F.col("passes") * F.col("n") - F.col("before")).drop("target", "n", "before"))

    # the block that the quota ends in: its rows in hashed order, up to the nearest
    edge = written(blocks.where("rest > 0 and rest < words").select("s", "b", "rest"))
    inside = place(slim).join(checked(edge), ["s", "b"]).groupBy("s", "b", "rest", "h").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("times"))
    run = F.sum(F.col("size") * F.col("times")).over(Window.partitionBy("s", "b").orderBy("h"))
    cut = inside.withColumn("before", run - F.col("size") * F.col("times")).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size") * F.col("times")))
    cut = written(cut.select("s", "b", F.col("h").alias("cut"), "times", F.round((F.col("rest") - F.col("before")) / F.col("size")).cast("long").alias("some")))

    # draws of each source, dealt to shards by the tree
    drawn = blocks.groupBy("s").agg((F.max(F.col("passes") * F.col("all")) + F.count_if(F.col("rest") > 0)).alias("q"))
    plan = blocks.join(shard_ends(drawn, shards, seed), "s").join(cut, ["s", "b"], "left")
    shard = lambda at: F.size(F.filter("ends", lambda e: e <= at)).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("passes") - 1), lambda k: shard(k * F.col("all") + F.col("rank")))
    each = F.when(F.col("passes") > 0, each).otherwise(F.array().cast("array<int>"))
    plan = written(plan.select("s", "b", "passes", "rest", "words", "cut", "times", "some", each.alias("each"), shard(F.col("passes") * F.col("all") + F.col("rank")).alias("last")))

    out = place(sized).join(checked(plan), ["s", "b"])
    also = (F.col("rest") > 0) & ((F.col("rest") >= F.col("words")) | (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & (F.col("some") == F.col("times"))))
    out = out.select("row", "size", "n", "target", "h", "passes", "each", "last", F.coalesce(also, F.lit(False)).alias("also"), F.when((F.col("h") == F.col("cut")) & (F.col("some") > 0) & (F.col("some") < F.col("times")), F.col("some")).alias("some"))
    if cut.where("some > 0 and some < times").limit(1).count():
        # equal rows of which some are taken: one stands for all, then each for itself
        names = [c for c in out.columns if c not in ("h", "some", "also")]
        ones = out.where("some is not null").groupBy("h", "some").agg(F.count(F.lit(1)).alias("k"), *(F.first(c).alias(c) for c in names))
        ones = ones.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1, F.lit(1 << 16).cast("long"))))
        ones = ones.withColumn("i", F.explode(F.sequence("lo", F.least(F.col("lo") + (1 << 16), F.col("k")) - 1)))
        out = out.where("some is null").unionByName(ones.withColumn("also", F.col("i") < F.col("some")).select(*out.columns))
    taken = F.col("size") > 0
    copies = F.when(taken, F.col("passes") + F.col("also").cast("int")).otherwise(0)
    at = F.when(~taken, F.array().cast("array<int>")).when(F.col("also"), F.array_append("each", F.col("last"))).otherwise(F.col("each"))
    added = {"size": F.col("size"), "source_size": F.col("n"), "target": F.col("target"), "taken": copies * F.col("size"), "copies": copies, "shards": at, "order": F.col("h")}
    kept = [c for c in docs.columns if c not in {f"mix_{k}" for k in added}]
    return out.select(*(F.col(f"row.`{c}`") for c in kept), *(v.alias(f"mix_{k}") for k, v in added.items()))


def query(spark, sf_dir: str) -> DataFrame:
    """All of documents; see the contract of op6."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", *(F.col(f"mix_{c}").alias(c) for c in ("size", "source_size", "target", "taken", "copies", "shards")))
