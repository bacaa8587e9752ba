"""Recurring lines found with a fixed-depth template tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checked, key_of, small_batches, whole, written
from .text import mix, pieces, powers, text_bytes, words

U = np.uint64
LINES = "key long, doc_id long, line int, leaf long, body long, cells binary"
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
WILD = U(0x6A09E667F3BCC909)


def parsed(depth: int, least_words: int):
    """Lines of documents with the leaf of the tree they fall to (the number
    of words and the first ``depth`` of them), a hash of the line and, for the
    first of its kind in the document, its words; words with a digit are
    variable fields from the start, but not in a line of up to ``depth`` words
    that has no others."""

    def lines_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [(x or "").split("\n") for x in batch["text"].to_pylist()]
        owner = np.repeat(np.arange(len(split)), [len(x) for x in split])
        number = np.concatenate([np.arange(len(x)) for x in split] or [np.zeros(0, int)])
        column = pa.array([y for x in split for y in x], pa.large_string())
        h, bounds, s, e = words(column, spans=True)
        digits = np.concatenate(([0], np.cumsum(_DIGIT[text_bytes(column)[0]], dtype=np.int32)))
        varies = digits[e] > digits[s]
        fixed = np.concatenate(([0], np.cumsum(~varies)))
        bare = (fixed[bounds[1:]] == fixed[bounds[:-1]]) & (np.diff(bounds) <= depth)
        h = np.where(varies & ~np.repeat(bare, np.diff(bounds)), WILD, h)
        up, down = powers(0xC2B2AE3D27D4EB4F, len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=total[1:])
        first, end = bounds[:-1], bounds[1:]
        n = (end - first).astype(np.uint64)
        body = mix((total[end] - total[first]) * down[first] + n).view(np.int64)
        leaf = mix(((total[np.minimum(first + depth, end)] - total[first]) * down[first]) ^ (n << U(32))).view(np.int64)
        own = np.flatnonzero(end - first >= least_words)
        by = np.lexsort((own, body[own], owner[own]))
        new = np.ones(len(own), bool)  # the first line of this kind in its document
        new[by[1:]] = (body[own][by[1:]] != body[own][by[:-1]]) | (owner[own][by[1:]] != owner[own][by[:-1]])
        cells = [h[first[i] : end[i]].tobytes() if x else None for i, x in zip(own.tolist(), new.tolist(), strict=True)]
        return pa.RecordBatch.from_pydict({"key": batch["key"].take(pa.array(owner[own])), "doc_id": batch["doc_id"].take(pa.array(owner[own])).cast(pa.int64()), "line": pa.array(number[own], pa.int32()), "leaf": pa.array(leaf[own]), "body": pa.array(body[own]), "cells": pa.array(cells, pa.binary())})

    def run(batches):
        for batch in pieces(batches):
            yield lines_of(batch)

    return run


def fields(depth: int):
    """The words of distinct lines below the tree's depth: a row for each with
    its place, and a hash of the leaf, the place and the word."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(a, 1 << 14)
                cells = [np.frombuffer(x, np.uint64)[depth:] for x in part["cells"].to_pylist()]
                sizes = [len(x) for x in cells]
                row = np.repeat(np.arange(len(cells)), sizes)
                place = np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, int)]) + depth
                h = np.concatenate([*cells, np.zeros(0, np.uint64)])
                leaf = part["leaf"].to_numpy().view(np.uint64)[row] + place.astype(np.uint64) * U(0x9E3779B97F4A7C15)
                take = pa.array(row)
                yield pa.RecordBatch.from_pydict({"leaf": part["leaf"].take(take), "body": part["body"].take(take), "n": part["n"].take(take), "blank": pa.array(mix(leaf).view(np.int64)), "word": pa.array(mix(leaf ^ mix(h)).view(np.int64)), "wild": pa.array(h == WILD)})

    return run


def templates(bodies: DataFrame, least_docs: int, depth: int, similar: float) -> DataFrame:
    """(leaf, body, template) of distinct lines ``bodies`` (leaf, body, n,
    cells).  A word is fixed where ``least_docs`` lines or more of its leaf
    have it at its place, else a variable field; a template is a leaf and its
    lines' fixed words, with variable fields at no more than 1 - ``similar``
    of all places.  Every step adds up by key, so a leaf of any size is never
    one task's."""
    split_up = bodies.select("leaf", "body", "n", "cells").mapInArrow(fields(depth), "leaf long, body long, n long, blank long, word long, wild boolean")
    common = split_up.where("not wild").groupBy("word").agg(F.sum("n").alias("k")).where(F.col("k") >= least_docs).select("word", F.lit(True).alias("fixed"))
    marked = split_up.join(common, "word", "left").select("leaf", "body", F.when(F.col("wild") | F.col("fixed"), F.col("word")).otherwise(F.col("blank")).alias("part"), F.when(F.col("wild") | F.col("fixed"), 0).otherwise(1).alias("varies"))
    shapes = marked.groupBy("leaf", "body").agg(F.bit_xor("part").alias("shape"), F.sum("varies").alias("varies"))
    short = F.length("cells") <= 8 * depth
    out = bodies.select("leaf", "body", (F.length("cells") / 8).alias("words"), short.alias("short")).join(shapes, ["leaf", "body"], "left")
    out = out.where(F.coalesce("varies", F.lit(0)) <= F.lit(1 - similar) * F.col("words") + 1e-9)
    return out.select("leaf", "body", F.when(F.col("short"), F.col("body")).otherwise(F.xxhash64("leaf", "shape")).alias("template"))


def recurring(docs: DataFrame, least_docs: int = 4, least_words: int = 1, depth: int = 3, similar: float = 0.8) -> DataFrame:
    """Lines to drop: key (of the row's doc_id and text) and line (from 0),
    with the line's template and its number of documents."""
    small_batches(docs.sparkSession)
    keyed = docs.select(key_of().alias("key"), "doc_id", "text")
    lines = keyed.mapInArrow(parsed(depth, least_words), LINES)
    busy = lines.where("cells is not null").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs).select("leaf")
    lines = written(lines.join(written(busy), "leaf"))
    bodies = written(lines.where("cells is not null").groupBy("leaf", "body").agg(F.count(F.lit(1)).alias("n"), F.first("cells").alias("cells")))
    shapes = checked(written(templates(bodies, least_docs, depth, similar)))
    told = lines.select("key", "doc_id", "line", "leaf", "body").join(shapes, ["leaf", "body"])
    told = written(told.select("key", "doc_id", "line", "template"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    known = told.select("template", "key", "doc_id").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), first.alias("first"))
    known = checked(written(known.where(F.col("n_docs") >= least_docs).select("template", "n_docs", F.col("first.key").alias("first_key"))))
    return told.join(known, "template").where("key <> first_key").select("key", "line", "template", "n_docs")


def drop_recurring(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with recurring lines dropped from text; all other columns,
    and their names, stay.  n_chars, where there is one, is counted anew for
    texts that lose lines.

    A line falls to the leaf of its number of words and its first ``depth``
    words; there its words are fixed or variable fields (see ``templates``).
    Templates that stand in ``least_docs`` different documents or more,
    however often in each, are dropped everywhere but in the document with the
    smallest doc_id (null last, then by a hash of the text), which keeps its
    lines of them.  Lines of fewer than ``least_words`` words (by default empty ones)
    and null texts stay as they are.  Rows that repeat doc_id and text are one
    document: what one keeps, all keep.  An empty table gives an empty
    result."""
    lost = recurring(docs, **settings).groupBy("key").agg(F.collect_set("line").alias("lost"))
    # merge: this table grows with the input and is never broadcast
    out = whole(docs, key_of().alias("key")).join(written(lost).hint("merge"), "key", "left")
    text = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains(F.col("lost"), i)), "\n")
    out = out.select("row", "lost", F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(text).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        n = F.when(F.col("lost").isNull(), F.col("row.n_chars")).otherwise(F.char_length("text"))
        new["n_chars"] = n.cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document: how many lines and characters it keeps, and their hash."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars_before"))
    out = drop_recurring(docs)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "chars_before", F.char_length(text).cast("long").alias("chars_kept"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
