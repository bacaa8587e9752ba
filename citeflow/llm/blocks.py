"""Exact corpus-wide counts in bounded hops.

Documents are dealt by hash into blocks of a bounded size.  Every block
sends the distinct keys it holds, with their counts, to the key's range (one
row per block and range, so a key that is everywhere costs one entry per
block); every range adds up what it gets and answers each block in the order
of that block's own keys.  With many ranges both ways go over lanes (see
``Route``).  Nothing reaches the driver and nothing is
broadcast.  A task holds one block, of about ``block_bytes`` or one longer
text, or one range.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, key_of, small_batches, written

U = np.uint64


def deal(docs: DataFrame, block_bytes: int, columns: list[str]) -> tuple[DataFrame, int, bool]:
    """(docs with only ``columns``, _times and _block; total bytes of text;
    whether rows repeat).  Rows that repeat doc_id and text stand once, with
    their number in _times, so copies of one row don't fill a block."""
    small_batches(docs.sparkSession)
    rows = docs.select(*columns, key_of().alias("_key"), F.xxhash64(F.lit(1), "text", "doc_id").alias("_more"))
    each = written(rows.groupBy("_key", "_more").agg(F.count(F.lit(1)).alias("_times"), F.first(F.octet_length("text")).alias("n")))
    total = each.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("_times").alias("most")).first()
    size, again = int(total["n"] or 0) + 64 * int(total["rows"]), (total["most"] or 0) > 1
    if again:
        many = written(each.where("_times > 1").drop("n"))
        rows = rows.dropDuplicates(["_key", "_more"]).join(many, ["_key", "_more"], "left").withColumn("_times", F.coalesce("_times", F.lit(1).cast("long")))
    else:
        rows = rows.withColumn("_times", F.lit(1).cast("long"))
    forget(each)
    n = max(1, math.ceil(size / block_bytes))
    return rows.select(*columns, "_times", F.pmod("_key", F.lit(n)).cast("int").alias("_block")), size, again


def split(keys: np.ndarray, n: int) -> np.ndarray:
    """The range of each key: bits other than the ones that order keys."""
    from .text import mix

    return ((mix(keys ^ U(0x5851F42D4C957F2D)) >> U(32)) * U(n) >> U(32)).astype(np.int64)


class Places:
    """Where each of some distinct keys stands, by a hash table: random
    look-ups, unlike a binary search, touch it once or twice."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = (1 << max(4, (3 * len(keys)).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _slot(self, x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> U(32))
        return ((x * U(0x9E3779B97F4A7C15)) >> U(64 - self.mask.bit_length())).astype(np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Places of x, which must all be there."""
        at = self._slot(x)
        out = self.slots[at]
        wrong = np.flatnonzero(self.keys[out] != x)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[self.keys[out[wrong]] != x[wrong]]
        return out


def parted(keys: np.ndarray, counts: np.ndarray, where: np.ndarray):
    """Yield (part, keys, counts) of sorted distinct keys by ``where``."""
    order = np.argsort(where, kind="stable")
    own = where[order]
    cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)] if len(own) else [0]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(own[x]), keys[order[x:y]], counts[order[x:y]]


def gathered(table: pa.Table, wire, count):
    """(keys, counts, cuts) of a range's rows, one after the other."""
    ks = [np.frombuffer(x, wire) for x in table["keys"].to_pylist()]
    cs = [np.frombuffer(x, count) for x in table["counts"].to_pylist()]
    return np.concatenate(ks), np.concatenate(cs), np.cumsum([0, *map(len, ks)])


def _messages(rows) -> pa.Table:
    rows = list(rows)
    return pa.table({"r": pa.array([x[0] for x in rows], pa.int32()), "block": pa.array([x[1] for x in rows], pa.int32()), "keys": pa.array([x[2].tobytes() for x in rows], pa.binary()), "counts": pa.array([x[3].tobytes() for x in rows], pa.binary())})


SENT = "r int, block int, keys binary, counts binary"
ANSWER = "block int, r int, answer binary"
#: Ranges that blocks send to themselves.
DIRECT = 4096


class Route:
    """The way of blocks' keys to ``n`` ranges, and of the answers back.

    Up to DIRECT ranges every block sends to each.  Beyond, a message would
    hold a few keys only: blocks send to lanes of about sqrt(n) ranges; in a
    lane, as many blocks together add up their counts and send to its ranges;
    and what these answer is handed on to each block.  ``range_of`` gives the
    range of a key, ``pack`` what the range is sent of it, ``cap`` the most
    that a block's count says."""

    def __init__(self, n: int, count, cap: int | None = None, range_of: Callable | None = None, wire=np.uint64):
        self.n, self.count, self.cap, self.wire = n, count, cap, wire
        self.range_of = range_of or (lambda keys: split(keys, n))
        self.width = 1 if n <= DIRECT else math.ceil(math.sqrt(n))

    def _counts(self, x: np.ndarray) -> np.ndarray:
        return (np.minimum(x, self.cap) if self.cap else x).astype(self.count)

    def send(self, docs: DataFrame, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """(r, block, keys, counts) of each _block's sorted distinct keys; r
        is a range, or a lane of them."""
        lane_wire = self.wire if self.width == 1 else np.uint64

        def emit(table: pa.Table) -> pa.Table:
            keys, counts = keys_of(table)
            block = table["_block"][0].as_py()
            return _messages((r, block, k.astype(lane_wire), self._counts(c)) for r, k, c in parted(keys, counts, self.range_of(keys) // self.width))

        return docs.groupBy("_block").applyInArrow(emit, SENT)

    def _batch(self):
        # lanes by batches of as many blocks; int: both are at most about sqrt(n)
        return F.xxhash64("r", F.floor(F.col("block") / self.width))

    def up(self, sent: DataFrame) -> DataFrame:
        """What ranges get: (r, block, keys, counts), where block stands for
        a batch of blocks if there are lanes."""
        if self.width == 1:
            return sent.select("r", F.col("block").cast("long").alias("block"), "keys", "counts")

        def merge(table: pa.Table) -> pa.Table:
            keys, counts, _ = gathered(table, np.uint64, self.count)
            every, inverse = np.unique(keys, return_inverse=True)
            total = np.bincount(inverse, counts, len(every)).astype(np.int64)
            rows = [(r, k.astype(self.wire).tobytes(), self._counts(c).tobytes()) for r, k, c in parted(every, total, self.range_of(every))]
            batch = table["batch"][0].as_py()
            return pa.table({"r": pa.array([x[0] for x in rows], pa.int32()), "block": pa.array([batch] * len(rows), pa.int64()), "keys": pa.array([x[1] for x in rows], pa.binary()), "counts": pa.array([x[2] for x in rows], pa.binary())})

        return sent.withColumn("batch", self._batch()).groupBy("batch").applyInArrow(merge, "r int, block long, keys binary, counts binary")

    def down(self, sent: DataFrame, answers: DataFrame, kind) -> DataFrame:
        """(block, r, answer) for every message of ``sent`` from the ranges'
        answers, which hold a ``kind`` for each key."""
        if self.width == 1:
            return answers.select(F.col("block").cast("int").alias("block"), "r", "answer")

        def back(table: pa.Table, told: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.table({"block": pa.array([], pa.int32()), "r": pa.array([], pa.int32()), "answer": pa.array([], pa.binary())})
            keys, _, cuts = gathered(table, np.uint64, self.count)
            every = np.unique(keys)
            value = self._answered(every, told, self.range_of(every), kind)[Places(every).of(keys)]
            return pa.table({"block": table["block"].cast(pa.int32()), "r": table["r"].cast(pa.int32()), "answer": pa.array([value[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

        return sent.withColumn("batch", self._batch()).groupBy("batch").cogroup(answers.groupBy("block")).applyInArrow(back, ANSWER)

    def _answered(self, keys: np.ndarray, answers: pa.Table, where: np.ndarray, kind) -> np.ndarray:
        out = np.zeros(len(keys), kind)
        by = dict(zip(answers["r"].to_pylist(), answers["answer"].to_pylist(), strict=True))
        for r, own, _ in parted(np.arange(len(keys)), np.arange(len(keys)), where):
            out[own] = np.frombuffer(by[r], kind)
        return out

    def answered(self, keys: np.ndarray, answers: pa.Table, kind) -> np.ndarray:
        """What a block was answered for its sorted distinct keys."""
        return self._answered(keys, answers, self.range_of(keys) // self.width, kind)


#: What ranges answer to: the rows that Route.up gives them.
TOLD = "block long, r int, answer binary"


def totals(wire, count, told: Callable[[np.ndarray], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """A range's rows to answers (block, r, answer): what ``told`` makes of
    the sums, in each block's key order."""

    def add(table: pa.Table) -> pa.Table:
        keys, counts, cuts = gathered(table, wire, count)
        _, inverse = np.unique(keys, return_inverse=True)
        total = told(np.bincount(inverse, weights=counts).astype(np.int64)).astype(count)[inverse]
        answers = [total[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"block": table["block"], "r": table["r"].cast(pa.int32()), "answer": pa.array(answers, pa.binary())})

    return add
