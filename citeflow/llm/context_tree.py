"""Context-tree weighting over bytes: a code length for every text."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .shared import repeated
from .text import _LOWER, chunks, mix, text_bytes, words

U = np.uint64
DEPTH = 5
#: Nearest bytes that a part of the tree lies below (each holds at most
#: 2**24 sequences), parts at least and at most, and bytes of text for each.
ROOT, TREES, MOST_TREES, TREE_BYTES = 3, 64, 1 << 20, 64 << 20
END_TOKEN = U(0x2545F4914F6CDD1D)
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, known_log double, score double, _times long"
_HALF = math.log(0.5)
_table = np.cumsum(np.concatenate(([0.0], np.log(np.arange(1, 4097) - 0.5))))  # log of (1/2)(3/2)...
_factor = np.cumsum(np.concatenate(([0.0], np.log(np.arange(1, 8193)))))


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""

    def rising(n):  # log of gamma(n + 1/2) / gamma(1/2)
        big = np.maximum(n, 4096).astype(float) + 0.5
        far = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3) - 0.5 * math.log(math.pi)
        return np.where(n <= 4096, _table[np.minimum(n, 4096)], far)

    def factorial(n):
        big = np.maximum(n, 8192).astype(float) + 1
        far = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3)
        return np.where(n <= 8192, _factor[np.minimum(n, 8192)], far)

    return rising(a) + rising(b) - factorial(a + b)


def grams(column):
    """Yield (first document, keys, bounds) by chunks of documents: for every
    byte of a lowered text and its end, the byte and the DEPTH bytes before
    it (byte 255 stands for what is outside), nearest in the low bits."""
    raw, off = text_bytes(column)
    for a, b in chunks(off, 2 << 20):
        x = _LOWER[raw[off[a] : off[b]]]
        sizes = np.diff(off[a : b + 1])
        starts = off[a:b] - off[a] + (DEPTH + 1) * np.arange(b - a)
        out = np.full(len(x) + (DEPTH + 1) * (b - a), 255, np.uint8)
        inside = np.arange(len(x)) + np.repeat((DEPTH + 1) * np.arange(b - a) + DEPTH, sizes)
        out[inside] = x
        keys = np.zeros(len(out) - DEPTH, np.uint64)
        for j in range(DEPTH + 1):
            keys |= out[DEPTH - j : len(out) - j].astype(np.uint64) << U(8 * j)
        take = np.ones(len(keys), bool)  # position i of keys stands for byte i + DEPTH
        for j in range(1, DEPTH + 1):
            take[starts[1:] - j] = False
        yield a, keys[take], np.concatenate(([0], np.cumsum(sizes + 1)))


def learnt(table: pa.Table) -> np.ndarray:
    """How often each text counts: as often as its row stands, or not at all."""
    return np.where(table["held_out"].to_numpy(), 0, table["_times"].to_numpy())


def gram_counts(table: pa.Table):
    """Distinct keys of a block, and how often its training texts have them."""
    train, keys, counts = learnt(table), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, k, bounds in grams(table["text"]):
        use = np.repeat(train[a : a + len(bounds) - 1], np.diff(bounds))
        for weight in np.unique(train[a : a + len(bounds) - 1]).tolist():
            u, n = np.unique(k[use == weight], return_counts=True)
            keys.append(u)
            counts.append(n * weight)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    by = np.argsort(keys)
    keys = keys[by]
    first = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[by], first) if len(first) else counts


def gram_keys(table: pa.Table) -> np.ndarray:
    """Distinct keys of a block, as ``gram_counts`` gives them."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(k) for _, k, _ in grams(table["text"]))]))


def word_counts(table: pa.Table):
    h, bounds = words(table["text"], lower=True)
    train = learnt(table)
    use = np.repeat(train, np.diff(bounds))
    keys, inverse = np.unique(np.concatenate((h, [END_TOKEN])), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate((use, [train.sum()])), len(keys)).astype(np.int64)
    return keys, counts


def tree_of(keys: np.ndarray, trees: int) -> np.ndarray:
    return (mix((keys >> U(8)) & U((1 << 8 * ROOT) - 1)) % U(trees)).astype(np.int64)


def joined(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the weighted probability, share of the own estimate in it) of
    nodes with these counts and sums of what is below."""
    kt = log_kt(n0, n1)
    weighted = _HALF + np.logaddexp(kt, below)
    return weighted, np.exp(_HALF + kt - weighted)


class Tree:
    """The part of the context tree below a set of contexts of ROOT bytes.

    Every node is a context of d bytes and a prefix of the next byte's bits;
    it holds how often the next bit was 0 or 1, the weighted probability of
    its part of the training bits, and the share of its own estimate in it.
    ``want`` are the nodes above that its keys' bits hang on."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.nodes, self.n0, self.n1, self.share = {}, {}, {}, {}
        self.want = np.unique(parent(bits(keys)[0].ravel(), ROOT))
        keys, counts = keys[counts > 0], counts[counts > 0]
        below = None
        for d in range(DEPTH, ROOT - 1, -1):
            if d < DEPTH:
                keys, inverse = np.unique(keys & U((1 << 8 * (d + 1)) - 1), return_inverse=True)
                counts = np.bincount(inverse, counts, len(keys)).astype(np.int64)
            node, bit = bits(keys)
            nodes, inverse = np.unique(node.ravel(), return_inverse=True)
            weight = np.tile(counts, 8)
            ones = np.bincount(inverse, weight * bit.ravel(), len(nodes)).astype(np.int64)
            zeros = np.bincount(inverse, weight, len(nodes)).astype(np.int64) - ones
            if below is None:
                weighted, share = log_kt(zeros, ones), np.ones(len(nodes))
            else:
                weighted, share = joined(zeros, ones, np.bincount(np.searchsorted(nodes, parent(below[0], d + 1)), below[1], len(nodes)))
            self.nodes[d], self.n0[d], self.n1[d], self.share[d] = nodes, zeros, ones, share
            below = nodes, weighted
        self.weighted = below[1]

    def sums(self) -> np.ndarray:
        """A row for each wanted node: it, and what this part adds to it."""
        at = np.searchsorted(self.want, parent(self.nodes[ROOT], ROOT))
        return np.column_stack([self.want.astype(float), *(np.bincount(at, x, len(self.want)) for x in (self.n0[ROOT], self.n1[ROOT], self.weighted))])

    def predict(self, keys: np.ndarray, above: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each key; ``above`` has, for
        each wanted node, the mixture so far and the weight left below."""
        nodes = {**self.nodes, ROOT - 1: self.want}
        a, w = {ROOT - 1: above[0]}, {ROOT - 1: above[1]}
        for d in range(ROOT, DEPTH + 1):
            at = np.searchsorted(nodes[d - 1], parent(nodes[d], d))
            p = (self.n1[d] + 0.5) / (self.n0[d] + self.n1[d] + 1)
            a[d] = a[d - 1][at] + w[d - 1][at] * self.share[d] * p
            w[d] = w[d - 1][at] * (1 - self.share[d])
        node, bit = bits(keys)
        node, one = node.ravel(), np.empty(node.size)
        left = np.arange(len(node))
        for d in range(DEPTH, ROOT - 2, -1):
            want = node[left] & U((1 << 8 * (d + 1)) - 1)
            at = np.minimum(np.searchsorted(nodes[d], want), max(0, len(nodes[d]) - 1))
            hit = nodes[d][at] == want if len(nodes[d]) else np.zeros(len(want), bool)
            one[left[hit]] = a[d][at[hit]] + w[d][at[hit]] / 2
            left = left[~hit]
        return np.log10(np.where(bit.ravel(), one, 1 - one)).reshape(8, -1).sum(0)


def bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the 8 bits of the last byte: its node (the context and the
    bits before it) and its value."""
    symbol, context = keys & U(255), keys & ~U(255)
    node = np.stack([context | U(1 << b) | (symbol >> U(8 - b)) for b in range(8)])
    bit = np.stack([(symbol >> U(7 - b)) & U(1) for b in range(8)])
    return node, bit.astype(bool)


def parent(nodes: np.ndarray, d: int) -> np.ndarray:
    """The same bits in the context without its farthest byte."""
    return nodes & U((1 << 8 * d) - 1)


def merged_sums(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, sums) of what several parts add to their wanted nodes."""
    part = np.concatenate([np.frombuffer(x).reshape(-1, 4) for x in rows])
    nodes, inverse = np.unique(part[:, 0].astype(np.uint64), return_inverse=True)
    return nodes, np.stack([np.bincount(inverse, part[:, j], len(nodes)) for j in (1, 2, 3)])


def crown(rows: list[bytes]) -> np.ndarray:
    """Depths 0 and 1 of the tree from the sums of all of depth 2: for every
    node of depth 1 the mixture so far, and the weight left below."""
    nodes, own = merged_sums(rows)
    sums = np.zeros((3, 1 << 16))
    sums[:, nodes.astype(np.int64)] = own
    n0, n1 = sums[:2].astype(np.int64)
    weighted, share = joined(n0, n1, sums[2])
    by_bits = lambda x: x.reshape(256, 256).sum(0)
    z0, z1 = by_bits(n0), by_bits(n1)
    kt0 = log_kt(z0, z1)
    share0 = np.exp(kt0 - np.logaddexp(kt0, by_bits(weighted)))
    a0, w0 = np.tile(share0 * (z1 + 0.5) / (z0 + z1 + 1), 256), np.tile(1 - share0, 256)
    return np.stack((a0 + w0 * share * (n1 + 0.5) / (n0 + n1 + 1), w0 * (1 - share)))


def _one(**columns) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def score(docs: DataFrame, block_bytes: int = 8 << 20, range_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score and bits_per_byte.

    score is the log10 probability, under the frozen model, of the text with
    A-Z lowered, as bytes and an end.  Every byte is eight binary decisions;
    each has its own context tree of depth 5, in which every node's
    Krichevsky-Trofimov estimate is mixed with those of all deeper nodes by
    their weighted probabilities.  The counts come from all texts whose
    crc32(doc_id) mod 10 is not 0.  The tree is dealt out by its contexts, in
    parts below three bytes, that meet below one byte and then at the crown;
    each block of documents asks it for the byte sequences that it holds, so
    no model is ever broadcast.

    Null texts are empty: one end.  A null doc_id counts as an empty id, and
    so is held out.  Repeated rows count as often as they stand.  Other
    columns are ignored.  An empty table gives an empty result; without any
    training text the model is uniform over bits."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    dealt, size, again = blocks.deal(docs.select("doc_id", "text", held.alias("held_out")), block_bytes, ["doc_id", "text", "held_out"])
    n = max(8, math.ceil(0.6 * size / range_bytes))
    trees = min(MOST_TREES, max(TREES, size // TREE_BYTES))
    by_block = dealt.groupBy("_block")
    route = blocks.Route(n, np.uint32)
    sent_words, sent_grams = route.send(dealt, word_counts), route.send(dealt, gram_counts)
    grams_up = route.up(sent_grams)

    def count_words(table: pa.Table) -> pa.Table:
        keys, counts, cuts = blocks.gathered(table, np.uint64, np.uint32)
        every, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, counts, len(every)).astype(np.int64)
        back = total[inverse]
        rows = [back[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        known = b"%d,%d" % ((total > 0).sum(), total.sum())
        return _one(block=([*table["block"].to_pylist(), None], pa.int64()), r=([*table["r"].to_pylist(), 0], pa.int32()), answer=([*rows, known], pa.binary()))

    told_words = route.up(sent_words).groupBy("r").applyInArrow(count_words, blocks.TOLD)
    size_of = told_words.where("block is null").select(F.split(F.col("answer").cast("string"), ",").cast("array<long>").alias("x")).select(F.col("x")[0].alias("v"), F.col("x")[1].alias("n"))
    size_of = size_of.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def merge(table: pa.Table) -> pa.Table:
        keys, counts, _ = blocks.gathered(table, np.uint64, np.uint32)
        keys, inverse = np.unique(keys, return_inverse=True)
        counts = np.bincount(inverse, counts, len(keys)).astype(np.int64)
        t = tree_of(keys, trees)
        rows = [(i, keys[t == i].tobytes(), counts[t == i].tobytes()) for i in np.unique(t).tolist()]
        return _one(tree=([x[0] for x in rows], pa.int32()), r=([table["r"][0].as_py()] * len(rows), pa.int32()), keys=([x[1] for x in rows], pa.binary()), counts=([x[2] for x in rows], pa.binary()))

    merged = grams_up.groupBy("r").applyInArrow(merge, "tree int, r int, keys binary, counts binary").groupBy("tree")

    def stems(table: pa.Table) -> pa.Table:
        keys, counts, _ = blocks.gathered(table, np.uint64, np.int64)
        sums = Tree(keys, counts).sums()
        byte = sums[:, 0].astype(np.int64) >> 8 & 255
        rows = [(int(x), sums[byte == x].tobytes()) for x in np.unique(byte)]
        return _one(tree=([table["tree"][0].as_py()] * len(rows), pa.int32()), byte=([x[0] for x in rows], pa.int32()), sums=([x[1] for x in rows], pa.binary()))

    def middle(table: pa.Table) -> pa.Table:
        nodes, (n0, n1, below) = merged_sums(table["sums"].to_pylist())
        weighted, _ = joined(n0.astype(np.int64), n1.astype(np.int64), below)
        at, inverse = np.unique(parent(nodes, ROOT - 1), return_inverse=True)
        sums = np.column_stack([at.astype(float), *(np.bincount(inverse, x, len(at)) for x in (n0, n1, weighted))])
        return _one(one=([0], pa.int32()), sums=([sums.tobytes()], pa.binary()))

    def crowned(table: pa.Table) -> pa.Table:
        top = crown(table["sums"].to_pylist()).reshape(2, 256, 256)
        return _one(byte=(list(range(256)), pa.int32()), crown=([top[:, x].tobytes() for x in range(256)], pa.binary()))

    def handed(table: pa.Table, top: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _one(tree=([], pa.int32()), byte=([], pa.int32()), above=([], pa.binary()))
        nodes, (n0, n1, below) = merged_sums(table["sums"].to_pylist())
        _, share = joined(n0.astype(np.int64), n1.astype(np.int64), below)
        a, w = np.frombuffer(top["crown"][0].as_py()).reshape(2, 256)[:, (nodes & U(255)).astype(np.int64)]
        above = np.stack((a + w * share * (n1 + 0.5) / (n0 + n1 + 1), w * (1 - share)))
        own = [above[:, np.searchsorted(nodes, np.frombuffer(x).reshape(-1, 4)[:, 0].astype(np.uint64))].tobytes() for x in table["sums"].to_pylist()]
        return _one(tree=(table["tree"].to_pylist(), pa.int32()), byte=(table["byte"].to_pylist(), pa.int32()), above=(own, pa.binary()))

    # up: parts below ROOT bytes, then below the nearest byte, then the crown; and down again
    told = merged.applyInArrow(stems, "tree int, byte int, sums binary").groupBy("byte")
    top = told.applyInArrow(middle, "one int, sums binary").groupBy("one").applyInArrow(crowned, "byte int, crown binary")
    tops = told.cogroup(top.groupBy("byte")).applyInArrow(handed, "tree int, byte int, above binary").groupBy("tree")

    def predict(table: pa.Table, above: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return _one(r=([], pa.int32()), keys=([], pa.binary()), logs=([], pa.binary()))
        keys, counts, cuts = blocks.gathered(table, np.uint64, np.int64)
        tree = Tree(keys, counts)
        from_above, byte = np.zeros((2, len(tree.want))), (tree.want >> U(8)) & U(255)
        for x, values in zip(above["byte"].to_pylist(), above["above"].to_pylist(), strict=True):
            from_above[:, byte == x] = np.frombuffer(values).reshape(2, -1)
        logs = tree.predict(keys, from_above).astype(np.float32)
        return _one(r=(table["r"].to_pylist(), pa.int32()), keys=(table["keys"].to_pylist(), pa.binary()), logs=([logs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))

    logs = merged.cogroup(tops).applyInArrow(predict, "r int, keys binary, logs binary")

    def reply(table: pa.Table, logs: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return _one(block=([], pa.int64()), r=([], pa.int32()), answer=([], pa.binary()))
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in logs["keys"].to_pylist()])
        value = np.concatenate([np.frombuffer(x, np.float32) for x in logs["logs"].to_pylist()])
        by = np.argsort(keys)
        keys, value = keys[by], value[by]
        rows = [value[np.searchsorted(keys, np.frombuffer(x, np.uint64))].tobytes() for x in table["keys"].to_pylist()]
        return _one(block=(table["block"].to_pylist(), pa.int64()), r=(table["r"].to_pylist(), pa.int32()), answer=(rows, pa.binary()))

    told_grams = grams_up.groupBy("r").cogroup(logs.groupBy("r")).applyInArrow(reply, blocks.TOLD)
    gram_answers = route.down(sent_grams, told_grams, np.float32).select("block", (-1 - F.col("r")).alias("r"), "answer")

    def final(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ("doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "known_log", "score", "_times")
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        if table.num_rows == 0:
            return pa.table({k: pa.array([], t) for k, t in zip(names, kinds, strict=True)})
        of_grams = np.array(answers["r"].to_pylist()) < 0
        answer = answers.filter(pa.array(~of_grams))
        h, bounds = words(table["text"], lower=True)
        keys = np.unique(np.concatenate((h, [END_TOKEN])))
        total = route.answered(keys, answer, np.int64)
        at = blocks.Places(keys).of(h)
        end = int(total[np.searchsorted(keys, END_TOKEN)])
        doc = np.repeat(np.arange(table.num_rows), np.diff(bounds))
        sums = lambda x: np.bincount(doc, x, table.num_rows)
        logged = sums(np.log10(total[at] + 0.1)) + math.log10(end + 0.1)
        known = sums(total[at] > 0) + (end > 0)
        answer = answers.filter(pa.array(of_grams))
        answer = answer.set_column(answer.schema.get_field_index("r"), "r", pa.array([-1 - x for x in answer["r"].to_pylist()], pa.int32()))
        keys = gram_keys(table)
        value = route.answered(keys, answer, np.float32)
        result, places = np.zeros(table.num_rows), blocks.Places(keys)
        for a, k, cuts in grams(table["text"]):
            # every text has at least its end, so no run is empty
            result[a : a + len(cuts) - 1] = np.add.reduceat(value[places.of(k)].astype(float), cuts[:-1])
        sizes = np.diff(text_bytes(table["text"])[1])
        values = (table["doc_id"], table["held_out"], np.diff(bounds) + 1, known.astype(np.int64), sizes, logged, result, table["_times"])
        return pa.table({k: (v.cast(t) if isinstance(v, pa.ChunkedArray) else pa.array(v, t)) for k, t, v in zip(names, kinds, values, strict=True)})

    every = route.down(sent_words, told_words.where("block is not null"), np.int64).union(gram_answers)
    out = by_block.cogroup(every.groupBy("block")).applyInArrow(final, OUT)
    out = repeated(out, "_times") if again else out.drop("_times")
    v, tokens = size_of.select("v").scalar(), size_of.select("n").scalar()
    out = out.withColumns({"train_tokens": tokens, "_v": v})
    base = F.col("known_log") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.1 * (F.col("_v") + 1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score", (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents; see the contract of op2."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
