"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .text import PUNCTUATION, pieces, words

#: Cells of a table of counts; tokens and stems are hashed into it.
CELLS = 1 << 18
STEMS = (4, 5)
PRIOR, DRIFT, SIGNIFICANT = 4.0, 1.2, 0.01
OUT = "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first:long,end:long,evidence:double>>"


def tokens(column):
    """Cells of every word and of its stems, and the documents' bounds."""
    h, bounds, stems = words(column, lower=True, space=PUNCTUATION, stems=STEMS)
    return [(x % np.uint64(CELLS)).astype(np.int32) for x in (*stems, h)], bounds


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence.

    They begin and end at positive scores.  A stack holds candidates with the
    running sums before and after them, and where the nearest candidate with a
    smaller sum before it lies; a new one absorbs those it improves on, so the
    whole scan is linear."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    at = np.flatnonzero(scores > 0)
    stack: list[tuple[float, float, int, int, int]] = []
    for i, before, after in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        first, j = i, len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= after:
                stack.append((before, after, first, i + 1, j))
                break
            before, _, first, _, up = stack[j]
            del stack[j:]
            j = up
    return [(a, b, r - x) for x, r, a, b, _ in stack]


class Weights:
    """Token log-odds with nested Dirichlet priors: a word's toxic share is
    drawn to that of its longest stem, that to its shorter stem's, and that
    to the share in the whole sample."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray):
        self.base = (toxic[0].sum() + 1) / (toxic[0].sum() + clean[0].sum() + 2)
        self.toxic, self.all, self.tail, self.size = toxic, toxic + clean, 1.0, 0.0

    def odds(self, cells) -> np.ndarray:
        share = np.full(len(cells[0]), self.base)
        for k, c in enumerate(cells):
            share = (self.toxic[k][c] + PRIOR * share) / (self.all[k][c] + PRIOR)
        return np.log(share / (1 - share)) - math.log(self.base / (1 - self.base)) - DRIFT

    def calibrate_tail(self, odds: np.ndarray) -> None:
        """lambda with mean(exp(lambda * score)) = 1 over clean tokens."""
        lo, hi = 1e-3, 8.0
        if not len(odds) or odds.max() <= 0:
            return
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.exp(mid * odds).mean() < 1 else (lo, mid)
        self.tail = lo

    def calibrate_size(self, best: np.ndarray) -> None:
        """log K of the extreme-value law, from clean texts' best segments
        less the log of their length: their mean is Euler's constant above."""
        if len(best):
            self.size = float(best.mean()) - 0.5772156649015329

    def evidence(self, column):
        """Per document: its features and its significant segments, each with
        the negative log of its E-value under the extreme-value law."""
        cells, bounds = tokens(column)
        odds = self.odds(cells)
        features, passages = np.zeros((len(bounds) - 1, 4)), []
        for i in range(len(bounds) - 1):
            own = odds[bounds[i] : bounds[i + 1]]
            size = math.log(len(own) + 1) + self.size
            found = [(a, b, self.tail * s - size) for a, b, s in segments(own)]
            kept = [{"first": a, "end": b, "evidence": e} for a, b, e in found if e > -math.log(SIGNIFICANT)]
            features[i] = (1.0, max((e for *_, e in found), default=-size), math.log1p(sum(x["evidence"] for x in kept)), len(kept) / (1 + len(own) / 100))
            passages.append(kept)
        return features, passages


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; x has a leading 1."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        keep = np.eye(len(w)) * ridge
        keep[0, 0] = 1e-6
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _held(column):
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = 20000):
    """(weights, coefficients) from at most ``most`` labelled training rows:
    the first by hash of doc_id.  Three quarters of them give the token
    counts, the rest the calibration.  Any label but 0 is toxic, and so is a
    doc_id labelled both ways; labels that are null or without a document are
    left out."""
    small_batches(docs.sparkSession)
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    part = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4))

    def count(batches):
        sums = np.zeros((2, len(STEMS) + 1, CELLS), np.int64)
        for batch in pieces(batches):
            cells, bounds = tokens(batch["text"])
            label = np.array(batch["toxic"].to_pylist(), np.int64)
            doc = np.repeat(np.arange(len(label)), np.diff(bounds))
            for k, c in enumerate(cells):
                seen = np.unique(doc * CELLS + c)  # once a document
                np.add.at(sums[:, k], (label[seen // CELLS], seen % CELLS), 1)
        y, k, c = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"cell": pa.array((y * (len(STEMS) + 1) + k) * CELLS + c, pa.int32()), "n": pa.array(sums[y, k, c], pa.int64())})

    counted = sample.where(part > 0).select("text", "toxic").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(2 * (len(STEMS) + 1) * CELLS)
    table[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    table = table.reshape(2, len(STEMS) + 1, CELLS)
    weights = Weights(table[1], table[0])

    # the calibration texts: bounded by the sample, reduced to scores on the executors
    def tail(batches):
        for batch in pieces(batches):
            odds = weights.odds(tokens(batch["text"])[0])
            bins = np.bincount(np.clip((odds + 16) * 16, 0, 511).astype(int), minlength=512)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(np.arange(512), pa.int32()), "n": pa.array(bins, pa.int64())})

    bins = sample.where((part == 0) & (F.col("toxic") == 0)).select("text").mapInArrow(tail, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    n = bins["n"].to_numpy()
    weights.calibrate_tail(np.repeat((bins["bin"].to_numpy() + 0.5) / 16 - 16, np.ceil(n * min(1, 1e6 / max(1, n.sum()))).astype(int)))

    def score(batches):
        for batch in pieces(batches):
            x = weights.evidence(batch["text"])[0]
            yield pa.RecordBatch.from_pydict({"x": pa.array(list(x), pa.list_(pa.float64())), "toxic": batch["toxic"]})

    def scored():
        got = sample.where(part == 0).select("text", "toxic").mapInArrow(score, "x array<double>, toxic int").toArrow()
        return np.array(got["x"].to_pylist(), float).reshape(-1, 4), got["toxic"].to_numpy().astype(float)

    x, y = scored()
    weights.calibrate_size(x[y == 0, 1])
    x, y = scored()
    if not len(y):
        return weights, np.array([-2.0, 0, 0, 0])
    return weights, logistic(x, y)


def score(docs: DataFrame, labels: DataFrame, most: int = 20000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1),
    predicted and passages (word intervals, end exclusive, with the negative
    log of their E-value).

    Only the text decides a score.  Empty and null texts have no passage and
    get the calibrated floor.  Held out are rows whose crc32(doc_id) mod 5 is
    0 (a null doc_id counts as an empty one).  Repeated rows score alike;
    other columns are ignored; an empty table gives an empty result, and
    without labels every score is the same low value."""
    weights, w = fit(docs, labels, most)

    def run(batches):
        for batch in pieces(batches):
            x, passages = weights.evidence(batch["text"])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.int64()), "held_out": batch["held_out"], "score": pa.array(p), "predicted": pa.array(p >= 0.5).cast(pa.int32()), "passages": pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())])))})

    return docs.select("doc_id", "text", _held(F.col("doc_id")).alias("held_out")).mapInArrow(run, OUT)


def keep_clean(docs: DataFrame, labels: DataFrame, most: int = 20000) -> DataFrame:
    """The rows of ``docs``, whole, whose score is under 0.5 (see ``score``)."""
    weights, w = fit(docs, labels, most)

    def run(batches):
        for batch in pieces(batches):
            x = weights.evidence(batch["text"])[0]
            yield batch.filter(pa.array(x @ w < 0))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents; see the contract of op8."""
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))
