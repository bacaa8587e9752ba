"""Homomorphic multiset fingerprints of documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import repeated, written

#: Exact lanes modulo 2**32, and packed sums (two counters of 32 bits each) for likeness.
EXACT, PACKED = 16, 48
_MASK = 1 | 1 << 32
#: What tells documents apart, in their order: no doc_id, the doc_id, a hash of the text.
ME = ("none", "id", "key")


def _features(body: Column) -> Column:
    """For every paragraph its digest, and the hashes of its runs of up to
    three words; both are summed, so neither their order nor the order of
    paragraphs matters."""
    blank = r"[\x20\x09-\x0D]+"
    runs = lambda p: F.element_at(F.transform(F.array(F.split(p, blank)), lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))), 1)
    paragraphs = F.split(body, "\n")
    digests = F.transform(paragraphs, lambda p: F.struct(F.lit(None).cast("long").alias("h"), F.sha2(p.cast("binary"), 256).alias("d")))
    words = F.transform(F.flatten(F.transform(paragraphs, runs)), lambda h: F.struct(h.alias("h"), F.lit(None).cast("string").alias("d")))
    return F.concat(digests, words)


def _sums() -> list[Column]:
    exact = [F.sum(F.when(F.col("d").isNotNull(), F.xxhash64(F.lit(i), "d").bitwiseAND(F.lit(0xFFFFFFFF)))).alias(f"e{i}") for i in range(EXACT)]
    packed = []
    for i in range(PACKED):
        h = F.col("h") if i < PACKED // 2 else F.xxhash64("h")
        packed.append(F.sum(F.shiftright(h, i % (PACKED // 2)).bitwiseAND(F.lit(_MASK))).alias(f"p{i}"))
    return [*exact, *packed, F.count("h").alias("n")]


def fingerprints(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """For every row of ``bodies``: its ``keys`` (unique together) and print,
    a struct of exact and packed sums and the number n of word runs.

    The sum of two prints is the print of both texts' paragraphs together:
    exact lanes add modulo 2**32, packed counters as numbers, which texts of
    under 2**31 words can't fill, so paragraphs can be inserted and deleted."""
    rows = bodies.select(*keys, F.explode(_features(F.coalesce("body", F.lit("")))).alias("f")).select(*keys, "f.h", "f.d")
    out = rows.groupBy(*keys).agg(*_sums())
    exact = F.array(*(F.pmod(F.col(f"e{i}"), F.lit(1 << 32)) for i in range(EXACT)))
    packed = F.array(*(F.coalesce(F.col(f"p{i}"), F.lit(0).cast("long")) for i in range(PACKED)))
    return out.select(*keys, F.struct(exact.alias("exact"), packed.alias("packed"), "n").alias("print"))


def text_of(p: Column) -> Column:
    """A print in hex: 16 exact lanes, then 48 packed sums."""
    part = lambda a, n: F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), n, "0")), "")
    return F.concat(part(p["exact"], 8), part(p["packed"], 16))


def _signed(p: Column) -> Column:
    """The 96 counters as signed sums of +1 and -1 over word runs."""
    one = lambda s: F.transform(p["packed"], lambda x: F.lit(2) * F.shiftright(x, s).bitwiseAND(F.lit(0xFFFFFFFF)) - p["n"])
    return F.concat(one(0), one(32))


def likeness(p: Column, q: Column) -> Column:
    """1 for equal prints, else the cosine of their signed sums, from 0 to 1:
    an estimate of the share of word runs that the texts have in common."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    a, b = _signed(p), _signed(q)
    pair = F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: dot(s["a"], s["b"]) / F.sqrt(F.greatest(dot(s["a"], s["a"]) * dot(s["b"], s["b"]), F.lit(1e-300)))), 1)
    return F.when((p["exact"] == q["exact"]) & (p["packed"] == q["packed"]), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), pair)))


def neighbours(docs: DataFrame) -> DataFrame:
    """Every distinct (none, id, key) with its n and rows, and the one before
    and after it by ascending id (nulls last), the ends meeting.  Ids only are
    sorted, in ranges; a table of one row a range links their ends."""
    ids = docs.groupBy(*ME).agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = written(ids.repartitionByRange(parts, *ME).withColumn("p", F.spark_partition_id()))
    me = F.struct(*ME)
    within = Window.partitionBy("p").orderBy(*ME)
    row = ids.select(*ME, "n", "rows", "p", F.lag(me).over(within).alias("prev"), F.lead(me).over(within).alias("next"))
    ends = ids.groupBy("p").agg(F.min(me).alias("low"), F.max(me).alias("high"))
    along, all_ = Window.orderBy("p"), Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("p", F.coalesce(F.lag("high").over(along), F.last("high").over(all_)).alias("before"), F.coalesce(F.lead("low").over(along), F.first("low").over(all_)).alias("after"))
    return row.join(F.broadcast(ends), "p").select(*ME, "n", "rows", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))


def edited(docs: DataFrame) -> DataFrame:
    """Every document and its edited text (see ``query``), with both prints
    and their likeness, and the likeness of its print to the next one's.

    Documents stand by ascending doc_id, nulls last, then by a hash of the
    text.  Null texts are empty.  Rows that repeat doc_id and text are one
    document, whose result stands as often as they do.  Other columns are
    ignored.  An empty table gives an empty result; a single document is its
    own next one."""
    text = F.coalesce("text", F.lit(""))
    all_ = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    links = written(neighbours(all_.withColumn("n", F.char_length("text"))))
    again = (links.agg(F.max("rows")).first()[0] or 0) > 1
    if again:
        all_ = all_.dropDuplicates(list(ME))
    cut = F.floor(F.col("n") / 4).cast("int")
    need = links.select(*(F.col(f"next.{c}").alias(c) for c in ME), F.struct(*ME).alias("to"), "prev", "n", "rows")
    heads = all_.join(need, list(ME)).select(*(F.col(f"to.{c}").alias(c) for c in ME), "prev", "n", "rows", F.substring(F.col("text"), F.lit(1), cut).alias("head"))
    both = all_.join(heads, list(ME))
    new = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n") - cut).cast("int")), F.col("head"))
    keys = [*ME, "prev", "rows", "n_chars", "sha"]
    both = both.select(*ME, "prev", "rows", F.col("n").cast("long").alias("n_chars"), "text", new.alias("new")).withColumn("sha", F.sha2(F.col("new").cast("binary"), 256))
    bodies = both.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("new").alias("body")))).alias("b")).select(*keys, "b.kind", "b.body")
    prints = fingerprints(bodies, [*keys, "kind"])
    own = F.max(F.when(F.col("kind") == 0, F.col("print")))
    one = prints.groupBy(*ME).agg(F.first("prev").alias("prev"), F.first("rows").alias("rows"), F.first("n_chars").alias("n_chars"), F.first("sha").alias("edited_sha256"), own.alias("own"), F.max(F.when(F.col("kind") == 1, F.col("print"))).alias("new"))
    self = F.struct("rows", "n_chars", "edited_sha256", "own", "new")
    nothing = lambda c: F.when(F.lit(False), c)
    mine = F.struct(*ME, self.alias("self"), nothing(F.col("own")).alias("other"))
    told = F.struct(*(F.col(f"prev.{c}").alias(c) for c in ME), nothing(self).alias("self"), F.col("own").alias("other"))
    met = one.select(F.inline(F.array(mine, told))).groupBy(*ME).agg(F.max("self").alias("s"), F.max("other").alias("other"))
    out = met.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "s.n_chars", "s.edited_sha256", text_of(F.col("s.own")).alias("fingerprint"), text_of(F.col("s.new")).alias("edited_fingerprint"), likeness(F.col("s.own"), F.col("s.new")).alias("near_edited"), likeness(F.col("s.own"), F.col("other")).alias("near_next"), "s.rows")
    return repeated(out, "rows") if again else out.drop("rows")


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents; see the contract of op1."""
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
