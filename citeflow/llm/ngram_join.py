"""Exact Jaccard self-join of documents on word shingles."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .shared import components, forget, repeated, written
from .text import mix, shingle_sets, trim

SETS = "doc_id long, n_shingles long, c1 long, c2 long, prefix array<long>, shingles array<long>, _times long"
#: Sets of a star and of a part of a unit that are searched at once, sets that
#: ask them at once, and rows of small units for one task.
STAR, GROUP, ASKS, TOGETHER = 64, 128, 1024, 2048


def divide_skip(lists: list[list[int]], need: int) -> list[int]:
    """Ids that stand in at least ``need`` of the sorted ``lists``.

    The longest lists are set aside; the short ones are merged on a heap that
    skips ids which cannot reach the threshold any more; whatever is left is
    looked up in the long lists by binary search."""
    if need <= 0 or len(lists) < need:
        return []
    lists = sorted(lists, key=len)
    longest = len(lists[-1])
    aside = min(need - 1, int(need / (0.02 * math.log2(longest + 1) + 1)))
    short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside :]
    least = need - aside
    heap = [(x[0], i, 0) for i, x in enumerate(short) if x]
    heapq.heapify(heap)
    out = []
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            have = len(popped)
            for left, x in zip(range(len(long_), 0, -1), long_, strict=True):
                if have >= need or have + left < need:
                    break
                at = bisect_left(x, top)
                have += at < len(x) and x[at] == top
            if have >= need:
                out.append(top)
            ahead = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            ahead = heap[0][0]
        for _, i, at in popped:
            at = bisect_left(short[i], ahead, at)
            if at < len(short[i]):
                heapq.heappush(heap, (short[i][at], i, at))
    return out


def enough(n: int, m: int, percent: int) -> int:
    """The smallest overlap of sets of n and m with Jaccard >= percent/100."""
    return -(-percent * (n + m) // (100 + percent))


def links(ids, sets, labels, asks, held, percent: int) -> list[tuple[int, int]]:
    """Links from the sets marked in ``asks`` to those marked in ``held``, by
    T-occurrence search over one inverted index.  Pairs that the labels, or
    links found before, connect already are passed over, so a group of copies
    costs one link for each."""
    order = np.array(sorted(np.flatnonzero(held), key=lambda i: (len(sets[i]), ids[i])), np.int64)
    sizes = np.array([len(sets[i]) for i in order])
    flat = np.concatenate([*(sets[i] for i in order), np.zeros(0, np.int64)])
    at = np.repeat(np.arange(len(order)), sizes)
    by = np.lexsort((at, flat))
    flat, at = flat[by], at[by]
    label = np.array(labels, np.int64)
    found = []
    for i in np.flatnonzero(asks):
        n = len(sets[i])
        lo, hi = np.searchsorted(sizes, [-(-percent * n // 100), 100 * n // percent + 1])
        able = label[order] != label[i]
        able[:lo] = able[hi:] = False
        if not able.any():
            continue
        first, last = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], "right")
        lists = [x.tolist() for x in (y[able[y]] for y in (at[a:b] for a, b in zip(first, last, strict=True) if b > a)) if len(x)]
        floor = enough(n, int(sizes[np.argmax(able)]), percent)
        for j in divide_skip(lists, floor):
            o = order[j]
            if label[o] == label[i]:
                continue
            need = enough(n, int(sizes[j]), percent)
            if need > floor and len(np.intersect1d(sets[i], sets[o], assume_unique=True)) < need:
                continue
            label[label == label[o]] = label[i]
            found.append((ids[i], ids[o]))
    return found


def _linker(percent: int):
    """Links inside each ``lot`` of a task's rows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("lot")
        column = table["shingles"].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        flat, off = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
        sets = [np.sort(flat[off[i] : off[i + 1]]) for i in range(table.num_rows)]
        lots, ids, labels, asks, held = (table[x].to_numpy() for x in ("lot", "doc_id", "label", "asks", "held"))
        edges = [0, *(np.flatnonzero(lots[1:] != lots[:-1]) + 1).tolist(), len(lots)]
        found = [x for a, b in zip(edges[:-1], edges[1:], strict=True) for x in links(ids[a:b], sets[a:b], labels[a:b], asks[a:b], held[a:b], percent)]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def magnitude(x: np.ndarray) -> np.ndarray:
    """Binary digits of counts: 1 is 1, 2 and 3 are 2, 4 to 7 are 3."""
    return np.frexp(x.astype(np.float64))[1]


def document_sets(docs: DataFrame, k: int, percent: int, block_bytes: int, range_bytes: int) -> tuple[DataFrame, bool]:
    """Per row of docs, equal ones once: the size of its set, its class (128 bits of hash of
    the set), its prefix and, where the prefix isn't empty, its set.

    Shingles stand in the order of their document counts (by binary digits; a
    block tells at most 255), then by hash.  Two sets that link share one of their first
    n - ceil(percent * n / 100) + 1 shingles in any such order; of those, the
    ones that no other document has lead nowhere and are left out."""
    dealt, size, again = blocks.deal(docs, block_bytes, ["doc_id", "text"])
    n = max(8, math.ceil(0.8 * size / range_bytes))
    # keys are the range and 32 bits of hash: enough to order by
    route = blocks.Route(n, np.uint8, 255, lambda keys: (keys >> np.uint64(32)).astype(np.int64), np.uint32)

    def cut_of(keys):
        return (keys & np.uint64(0xFFFFFFFF)) | (blocks.split(keys, n).astype(np.uint64) << np.uint64(32))

    def keys_of(table):
        sets = shingle_sets(table["text"], k)
        return np.unique(cut_of(np.concatenate([*sets, np.zeros(0, np.uint64)])), return_counts=True)

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64())), ("_times", pa.int64())])

    def both(table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return schema.empty_table()
        sets = shingle_sets(table["text"], k)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        cut = cut_of(flat)
        keys = np.unique(cut)
        total = route.answered(keys, answers, np.uint8)
        df = total[blocks.Places(keys).of(cut)] if len(keys) else np.zeros(0, np.uint8)
        at, rows = 0, ([], [], [], [], [], [], table["_times"].to_pylist())
        for x, doc in zip(sets, table["doc_id"].to_pylist(), strict=True):
            m = len(x)
            own = df[at : at + m]
            at += m
            first = m - -(-percent * m // 100) + 1 if m else 0
            rare = np.lexsort((x, own))[:first]
            prefix = x[rare[own[rare] > 1]]
            with np.errstate(over="ignore"):
                c1, c2 = (mix(x).sum(), mix(x ^ np.uint64(0xA0761D6478BD642F)).sum()) if m else (np.uint64(0), np.uint64(0))
            rows[0].append(doc)
            rows[1].append(m)
            rows[2].append(int(c1.astype(np.int64)))
            rows[3].append(int(c2.astype(np.int64)))
            rows[4].append(prefix.view(np.int64))
            rows[5].append(x.view(np.int64) if len(prefix) else None)
        del sets, flat, cut, keys
        trim()
        return pa.table([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    sent = route.send(dealt, keys_of)
    told = route.up(sent).groupBy("r").applyInArrow(blocks.totals(np.uint32, np.uint8, magnitude), blocks.TOLD)
    answers = route.down(sent, told, np.uint8)
    return dealt.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(both, SETS), again


def _units(members: DataFrame) -> DataFrame:
    """(area, unit, n, asks, major, cost) of (area, unit, rep, label): the
    sets of a unit, those outside its largest label, and how often sets are
    sent if these ask all others."""
    by = members.groupBy("area", "unit", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("area", "unit").agg(F.sum("k").alias("n"), F.max(F.struct("k", "label")).alias("top"))
    by = by.select("area", "unit", "n", (F.col("n") - F.col("top.k")).alias("asks"), F.col("top.label").alias("major"))
    return by.withColumn("cost", F.col("n") * F.ceil(F.col("asks") / ASKS) + F.col("asks") * F.ceil(F.col("n") / GROUP))


def _lots(members: DataFrame, tasks: int) -> DataFrame:
    """(lot, task, doc_id, label, asks, held): every set is held in one part
    of its unit, and those outside the largest label ask in every part."""
    part, chunk = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / GROUP)), F.pmod(F.xxhash64(F.lit(1), "rep"), F.ceil(F.col("asks") / ASKS))
    count = lambda x, size: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(x / size) - 1))
    held = members.select("unit", "n", "asks", "rep", "label", part.alias("p"), count(F.col("asks"), ASKS).alias("c"), F.lit(False).alias("ask"))
    ask = members.where("label <> major").select("unit", "n", "asks", "rep", "label", count(F.col("n"), GROUP).alias("p"), chunk.alias("c"), F.lit(True).alias("ask"))
    lot = F.xxhash64("unit", "p", "c")
    task = F.when((F.col("n") <= GROUP) & (F.col("asks") <= ASKS), F.pmod(F.xxhash64("unit"), F.lit(tasks))).otherwise(lot)
    return held.union(ask).select(lot.alias("lot"), task.alias("task"), F.col("rep").alias("doc_id"), "label", F.col("ask").alias("asks"), (~F.col("ask")).alias("held"))


def join(docs: DataFrame, k: int = 5, percent: int = 75, block_bytes: int = 4 << 20, range_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when their sets of k-word shingles have a Jaccard
    similarity of ``percent``/100 or more; component_id is the smallest
    doc_id reachable by links.  The join is exact:

    * equal sets form a class, which its smallest doc_id stands for;
    * sets that share a shingle of their prefixes are candidates; each is
      first held against the smallest candidate of its shingles, which joins
      a group of near copies by a star and not by all pairs;
    * sets that share a prefix shingle and still lie in different components
      are searched against each other by T-occurrence (``divide_skip``): the
      area that shingles connect as a whole, or list by list of the sets that
      have a shingle (equal lists once), whichever sends fewer sets.  There
      only sets outside the largest component ask, in lots of bounded size.

    Texts that are null or have no word have an empty set and are linked with
    nothing.  Rows that share a doc_id are one document with several texts,
    which are linked; rows that repeat doc_id and text have the same result.
    Rows without doc_id link with nothing and have no component_id.  Other
    columns are ignored; an empty table gives an empty result."""
    sets, again = document_sets(docs, k, percent, block_bytes, range_bytes)
    sets = written(sets)
    known = sets.where("doc_id is not null and n_shingles > 0")
    classes = written(known.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")))
    some = known.where("size(prefix) > 0").alias("s")
    reps = some.join(classes.alias("c"), (F.col("s.c1") == F.col("c.c1")) & (F.col("s.c2") == F.col("c.c2")) & (F.col("doc_id") == F.col("rep"))).select("rep", F.explode("prefix").alias("key"))
    reps = written(reps)
    heads = reps.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head <> last")
    entries = written(reps.join(heads.select("key", "head"), "key"))
    forget(reps)
    bodies = known.where("shingles is not null").select("doc_id", "shingles")

    # near copies: each against the smallest candidate it shares most with
    best = entries.where("rep <> head").groupBy("rep", "head").agg(F.count(F.lit(1)).alias("n"))
    best = best.groupBy("rep").agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("head"))
    counted = best.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts"))
    star = written(best.join(counted, "head").select(F.xxhash64("head", F.pmod(F.xxhash64("rep"), "parts")).alias("lot"), "head", F.col("rep").alias("doc_id")))
    yes, no = F.lit(True), F.lit(False)
    asked = star.select("lot", "doc_id", no.alias("asks"), yes.alias("held"))
    asked = asked.union(star.select("lot", "head").distinct().select("lot", "head", yes, no))
    link = _linker(percent)
    near = written(asked.join(bodies, "doc_id").withColumn("label", F.col("doc_id")).groupBy("lot").applyInArrow(link, "a long, b long"))
    stars = components(near)
    forget(star, near)

    # what still shares a prefix shingle across components, by its list
    placed = entries.select("key", "rep").join(stars.select(F.col("node").alias("rep"), "component"), "rep", "left")
    placed = written(placed.select("key", "rep", F.coalesce("component", "rep").alias("label")))
    forget(entries)
    lists = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64(F.lit(i), "rep")).alias(f"x{i}") for i in (0, 1)))
    lists = written(lists.where("low <> high").groupBy("n", "x0", "x1").agg(F.min("key").alias("key"), F.first("low").alias("low")))
    rest = written(placed.join(lists.select("key", "n", "low"), "key"))
    forget(placed, lists)
    # labels that lists connect are an area; it is searched whole or by lists
    areas = components(rest.select(F.col("label").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("label"), F.col("component").alias("area"))
    own = written(rest.select("rep", "label").distinct().join(areas, "label", "left").select("rep", "label", F.coalesce("area", "label").alias("area")))
    whole_ = own.select("area", F.col("area").alias("unit"), "rep", "label")
    parts_ = rest.select("rep", "label", F.col("key").alias("unit")).join(own.select("rep", "area"), "rep").select("area", "unit", "rep", "label")
    cost = {k: written(_units(x)) for k, x in (("whole", whole_), ("parts", parts_))}
    better = cost["whole"].select("area", "cost").join(cost["parts"].groupBy("area").agg(F.sum("cost").alias("other")), "area")
    better = written(better.select("area", (F.col("cost") <= F.col("other")).alias("whole")))
    lots = [x.join(better.where("whole" if k == "whole" else "not whole").select("area"), "area").join(cost[k], ["area", "unit"]) for k, x in (("whole", whole_), ("parts", parts_))]
    lots = _lots(lots[0].unionByName(lots[1]), max(1, own.count() // TOGETHER))
    far = lots.join(bodies, "doc_id").groupBy("task").applyInArrow(link, "a long, b long")

    # several texts of one doc_id
    several = known.groupBy("doc_id").agg(F.min("c1").alias("c1"), F.max("c1").alias("high")).where("c1 <> high").select("doc_id")
    own = known.select("doc_id", "c1", "c2").join(several, "doc_id").join(classes, ["c1", "c2"])
    found = components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).union(far).union(own.select("doc_id", "rep")))
    forget(stars)

    classes = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"), "last")
    classes = written(classes.where("component <> last").drop("last"))
    out = sets.select("doc_id", "n_shingles", *(F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in ("c1", "c2")), "_times")
    full, bare = out.where("n_shingles > 0"), out.where("n_shingles = 0").select("doc_id", "n_shingles", "_times", F.lit(None).cast("long").alias("component"))
    out = full.join(classes, ["c1", "c2"], "left").select("doc_id", "n_shingles", "_times", "component").union(bare)
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), "_times")
    return repeated(out, "_times") if again else out.drop("_times")


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents; see the contract of op4."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
