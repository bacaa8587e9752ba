"""Exact removal of passages that occur more than once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .shared import repeated
from .text import text_bytes, windows, words

OUT = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<first:long,end:long>>, _times long"
KINDS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("_times", pa.int64())])


def remove_repeats(docs: DataFrame, window: int = 35, block_bytes: int = 4 << 20, range_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the
    words that stay, joined by one space) and removed (maximal intervals of
    word positions, end exclusive).

    A word goes when a window of ``window`` consecutive words that covers it
    has the same words as a window starting anywhere else, the same document
    included.  Rabin-Karp hashes of every window are counted over the whole
    corpus; windows are judged on the input, never on what is left.  Two
    windows count as equal when 64 hash bits and the range agree; ranges grow
    with the input, so the odds of a false match don't.

    Null and empty texts, and texts shorter than the window, lose nothing.
    Repeated rows repeat each other's windows.  Other columns are ignored.
    An empty table gives an empty result."""
    dealt, size, again = blocks.deal(docs, block_bytes, ["doc_id", "text"])
    route = blocks.Route(max(8, math.ceil(1.5 * size / range_bytes)), np.uint8, 2)

    def own(table):
        h, bounds = words(table["text"])
        at, w = windows(h, bounds, window)
        return h, bounds, at, w

    def keys_of(table):
        _, bounds, at, w = own(table)
        keys, inverse = np.unique(w, return_inverse=True)
        times = np.minimum(table["_times"].to_numpy(), 2)[np.searchsorted(bounds, at, "right") - 1]
        return keys, np.minimum(np.bincount(inverse, times, len(keys)), 2).astype(np.int64)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        h, bounds, at, w = own(table)
        keys = np.unique(w)
        hit = route.answered(keys, answers, np.uint8) >= 2
        again = at[hit[blocks.Places(keys).of(w)]] if len(keys) else at
        cover = np.zeros(len(h) + 1, np.int32)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        raw, off = text_bytes(table["text"])
        data = raw.tobytes()
        kept, removed, lost = [], [], []
        for i in range(len(bounds) - 1):
            g = gone[bounds[i] : bounds[i + 1]]
            parts = data[off[i] : off[i + 1]].split()
            if g.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0])))).reshape(-1, 2)
                removed.append([{"first": int(a), "end": int(b)} for a, b in edge])
                parts = [parts[j] for j in np.flatnonzero(~g)]
            else:
                removed.append([])
            lost.append(int(g.sum()))
            kept.append(b" ".join(parts).decode("utf-8", "replace"))
        return pa.table([table["doc_id"].cast(pa.int64()), np.diff(bounds), lost, kept, removed, table["_times"]], schema=KINDS)

    sent = route.send(dealt, keys_of)
    told = route.up(sent).groupBy("r").applyInArrow(blocks.totals(np.uint64, np.uint8, lambda x: np.minimum(x, 2)), blocks.TOLD)
    answers = route.down(sent, told, np.uint8)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return cut(left, right) if left.num_rows else KINDS.empty_table()

    out = dealt.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(both, OUT)
    return repeated(out, "_times") if again else out.drop("_times")


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents; see the contract of op7."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
