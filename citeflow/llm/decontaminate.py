"""Benchmark passages in documents, found through spaced seeds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checked, forget, key_of, small_batches, whole, written
from .text import PUNCTUATION, mix, pieces, powers, words

U = np.uint64
#: 1: the word counts, 0: it may be any word.  Every run of at least 10 same
#: words with at least 75 % the same holds one of these: such a run of 28 words
#: or more has a half that is one too, and up to 27 tests/llm enumerates them.
MASKS = ("1101111", "1100010111", "11101001001", "1100010000111", "1101000100011", "101010001101", "1011111")
LEAST, SHARE, SPAN = 10, 0.75, max(map(len, MASKS))
#: Bits of the seed filter for each seed, and at most; more seeds make it let
#: more words through to the join, which decides alone.
FILTER_BITS, FILTER_MOST, PROBES = 32, 1 << 28, 4
#: Word positions of one document that are verified in one row.
STRETCH = 4096
#: Pairs of a document and an item up to which they are sent to the texts.
MEETS = 100_000


def spaced(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words at the mask's ones, for every start."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up = powers(0xC2B2AE3D27D4EB4F, 64)[0]
    out = np.zeros(n, np.uint64)
    for j in np.flatnonzero(np.array(list(mask)) == "1"):
        out += h[j : j + n] * up[j % 64]
    return mix(out + U(len(mask)))


def need_of(n: int, least: int, share: float) -> int:
    """The same words that an overlap with an item of n words must have."""
    return min(least, math.ceil(share * n - 1e-9))


def masks_of(n: int, least: int, share: float) -> tuple[str, ...]:
    """Masks that every accepted overlap with an item of n words holds: MASKS,
    or for shorter items and looser rules the plain run that the same words
    leave somewhere however the others part them."""
    if n >= SPAN and least >= LEAST and share >= SHARE:
        return MASKS
    need = need_of(n, least, share)
    fewest = (max(need, math.ceil(share / (1 - share) * z - 1e-9) if z else 0) / (z + 1) for z in range(n - need + 1 if share < 1 else 1))
    return ("1" * max(1, math.ceil(min(fewest))),)


def reach_of(least: int, share: float) -> int:
    """An accepted overlap has an accepted part this near to its seed."""
    return 2 * math.ceil(least / share)


def marks(h: np.ndarray, bounds: np.ndarray, owner: np.ndarray, at: np.ndarray, reach: int, none: int) -> np.ndarray:
    """16 bits of each word around ``at``; ``none`` outside the text."""
    x = at[:, None] + np.arange(-reach, reach + 1)
    inside = (x >= bounds[owner][:, None]) & (x < bounds[owner + 1][:, None])
    own = (h[np.clip(x, 0, len(h) - 1)] >> U(48)).astype(np.uint16)
    return np.where(inside, np.maximum(own, 2), none).astype(np.uint16)


def overlap(doc: np.ndarray, item: np.ndarray, need: int, share: float):
    """(first, n_words, n_same) of the run with most same words, and at least
    the share of them, of two texts laid side by side."""
    same = doc == item
    # a run has the share if this sum doesn't sink over it; for each end the
    # first start with a sum as low has the most same words
    total = np.concatenate(([0.0], np.cumsum(same - share)))
    count = np.concatenate(([0], np.cumsum(same)))
    start = np.searchsorted(-np.minimum.accumulate(total), -total - 1e-9)
    b = int(np.argmax(count - count[start]))
    a, m = int(start[b]), int(count[b] - count[start[b]])
    if m < max(1, need):
        return None
    a += int(np.argmax(same[a:b]))
    return a, b - a, m


def _lowered(batch):
    return words(batch["text"], lower=True, space=PUNCTUATION)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), -1)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def benchmark_tables(benchmark: DataFrame, least: int, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names, items, seeds), written: item_id by item; each distinct word
    sequence once; and its seeds with their place and the words around."""
    small_batches(benchmark.sparkSession)
    reach = reach_of(least, share)

    def split(batches):
        for batch in pieces(batches):
            h, bounds = _lowered(batch)
            own = [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield _batch(item_id=batch["item_id"].cast(pa.int64()), words=pa.array(own, pa.binary()))

    split_up = benchmark.select("item_id", "text").mapInArrow(split, "item_id long, words binary").where(F.length("words") > 0)
    split_up = written(split_up.withColumn("item", F.xxhash64("words")))
    items = written(split_up.groupBy("item").agg(F.first("words").alias("words")))

    def seeds(batches):
        for batch in batches:
            for item, own in zip(batch["item"].to_pylist(), batch["words"].to_pylist(), strict=True):
                h = np.frombuffer(own, np.uint64)
                for mask in masks_of(len(h), least, share):
                    keys = spaced(h, mask)
                    for a in range(0, len(keys), STRETCH):
                        at = np.arange(a, min(a + STRETCH, len(keys)))
                        n = len(at)
                        around = marks(h, np.array([0, len(h)]), np.zeros(n, np.int64), at, reach, 1)
                        yield _batch(seed=pa.array(keys[at].view(np.int64)), mask=pa.array([mask] * n), item=pa.array([item] * n, pa.int64()), place=pa.array(at, pa.int32()), n=pa.array([len(h)] * n, pa.int32()), around_item=_fixed(around))

    return split_up.select("item", "item_id"), items, written(items.mapInArrow(seeds, "seed long, mask string, item long, place int, n int, around_item binary"))


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter over the seeds, of at most FILTER_MOST bits."""
    n = seeds.count()
    bits = 1 << min(FILTER_MOST.bit_length() - 1, max(16, (FILTER_BITS * n).bit_length()))
    at = F.explode(F.array(*(F.shiftrightunsigned("seed", 16 * i).bitwiseXOR(F.shiftrightunsigned("seed", 5 + 9 * i)).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES))))
    cells = seeds.select(at.alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("x")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[cells["cell"].to_numpy()] = cells["x"].to_numpy().view(np.uint64)
    return out


def passes(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of the keys that the filter lets through."""
    at = np.arange(len(keys))
    for i in range(PROBES):
        k = keys[at]
        b = ((k >> U(16 * i)) ^ (k >> U(5 + 9 * i))) & U(len(filter_) * 64 - 1)
        at = at[(filter_[(b >> U(6)).astype(np.int64)] >> (b & U(63))) & U(1) == 1]
    return at


def met(docs: DataFrame, seeds: DataFrame, least: int, share: float) -> DataFrame:
    """(key, item, shift, n): where seeds of a document and an item of n words
    meet and enough words around are the same by 16 bits; the item's word i
    lies on the document's word shift + i.  Written, as what goes in is: two
    Python stages in one task would hold twice the memory."""
    reach, filter_ = reach_of(least, share), seed_filter(seeds)
    masks = [r["mask"] for r in seeds.select("mask").distinct().collect()]  # MASKS and plain runs of up to LEAST words

    def seek(batches):
        for batch in pieces(batches):
            h, bounds = _lowered(batch)
            keys = batch["key"].to_numpy()
            for mask in masks:
                k = spaced(h, mask)
                at = passes(filter_, k)
                owner = np.searchsorted(bounds, at, "right") - 1
                inside = at + len(mask) <= bounds[owner + 1]
                for a in range(0, int(inside.sum()), STRETCH):
                    x, o = at[inside][a : a + STRETCH], owner[inside][a : a + STRETCH]
                    yield _batch(key=pa.array(keys[o]), seed=pa.array(k[x].view(np.int64)), pos=pa.array(x - bounds[o], pa.int64()), around=_fixed(marks(h, bounds, o, x, reach, 0)))

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                n = batch["n"].to_numpy()
                same = (_matrix(batch["around"]) == _matrix(batch["around_item"])).sum(1)
                sizes, of = np.unique(n, return_inverse=True)
                enough = same >= np.array([need_of(int(x), least, share) for x in sizes])[of]
                shift = batch["pos"].to_numpy() - batch["place"].to_numpy()
                yield _batch(key=batch["key"], item=batch["item"], shift=pa.array(shift, pa.int64()), n=batch["n"]).filter(pa.array(enough))

    sought = written(docs.select(key_of().alias("key"), "text").mapInArrow(seek, "key long, seed long, pos long, around binary"))
    pairs = sought.join(seeds.drop("mask"), "seed").select("key", "item", "pos", "place", "n", "around", "around_item")
    out = written(pairs.mapInArrow(near, "key long, item long, shift long, n int").distinct())
    forget(sought)
    return out


def found(docs: DataFrame, items: DataFrame, seeds: DataFrame, least: int, share: float) -> DataFrame:
    """(key, item, first, n_words, n_same): the best overlap of every document
    and item that have one, judged on all their words."""
    near = met(docs, seeds, least, share)
    lists = near.groupBy("key", F.floor(F.col("shift") / STRETCH).alias("part")).agg(F.collect_list(F.struct("item", "shift", "n")).alias("meets"))

    def cut(batches):
        for batch in pieces(batches, 1 << 18):
            h, bounds = _lowered(batch)
            rows = []
            for i, (key, meets) in enumerate(zip(batch["key"].to_pylist(), batch["meets"].to_pylist(), strict=True)):
                own = h[bounds[i] : bounds[i + 1]]
                for m in meets:
                    lo = max(0, m["shift"])
                    rows.append((key, m["item"], m["shift"], lo, own[lo : m["shift"] + m["n"]].tobytes()))
                    if len(rows) >= STRETCH:
                        yield _batch(**{k: pa.array([r[j] for r in rows], t) for j, (k, t) in enumerate(kinds)})
                        rows = []
            yield _batch(**{k: pa.array([r[j] for r in rows], t) for j, (k, t) in enumerate(kinds)})

    kinds = [("key", pa.int64()), ("item", pa.int64()), ("shift", pa.int64()), ("lo", pa.int64()), ("part", pa.binary())]
    if near.limit(MEETS + 1).count() <= MEETS:
        lists = F.broadcast(lists)
    texts = docs.select(key_of().alias("key"), "text").join(lists, "key").select("key", "text", "meets")
    cuts = written(texts.mapInArrow(cut, "key long, item long, shift long, lo long, part binary"))

    def verify(batches):
        for batch in batches:
            rows = []
            for key, item, shift, lo, part, own in zip(*(batch[c].to_pylist() for c in ("key", "item", "shift", "lo", "part", "words")), strict=True):
                x, y = np.frombuffer(part, np.uint64), np.frombuffer(own, np.uint64)
                got = overlap(x, y[lo - shift : lo - shift + len(x)], need_of(len(y), least, share), share)
                if got:
                    rows.append((key, item, lo + got[0], got[1], got[2]))
            yield _batch(**{k: pa.array([r[j] for r in rows], pa.int64()) for j, k in enumerate(("key", "item", "first", "n_words", "n_same"))})

    got = cuts.join(items, "item").select("key", "item", "shift", "lo", "part", "words").mapInArrow(verify, "key long, item long, first long, n_words long, n_same long")
    best = got.groupBy("key", "item").agg(F.max(F.struct("n_same", (-F.col("n_words")).alias("m"), (-F.col("first")).alias("f"))).alias("b"))
    return best.select("key", "item", (-F.col("b.f")).alias("first"), (-F.col("b.m")).alias("n_words"), "b.n_same")


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, whole, that overlap no benchmark item (see
    ``overlaps``); repeated rows stay or go together, null texts stay."""
    _, items, seeds = benchmark_tables(benchmark, least, share)
    bad = written(found(docs, items, seeds, least, share).select("key").distinct())
    return whole(docs, key_of().alias("key")).join(checked(bad), "key", "left_anti").select("row.*")


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """A row for every document and benchmark item that overlap: doc_id,
    item_id, first (word position), n_words, n_same.

    Words are maximal runs of letters and digits, A-Z lowered.  An overlap is
    a run of words, the item laid on the document at some place, in which at
    least ``least`` words (or ``share`` of a shorter item) and ``share`` of
    the run are the same; the one with most same words is reported.  Every
    overlap holds one of the masks' seeds (see MASKS), so the hashes of both
    sides' seeds are joined, pairs with too few same words around are left
    out, and the others are verified on all words of the item.  Documents'
    seeds are first held against a filter of bounded size; neither side is
    collected, and only documents with a pair are read a second time.

    Null and empty texts and items match nothing; a null doc_id or item_id is
    reported as it is.  Repeated rows of either table repeat.  Other columns
    are ignored.  Empty tables give an empty result."""
    names, items, seeds = benchmark_tables(benchmark, least, share)
    best = written(found(docs, items, seeds, least, share))
    out = checked(best.join(names, "item")).join(docs.select(key_of().alias("key"), "doc_id"), "key")
    return out.select("doc_id", "item_id", "first", "n_words", "n_same")


def query(spark, sf_dir: str) -> DataFrame:
    """Every overlap of documents with benchmark."""
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
