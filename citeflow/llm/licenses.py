"""Licence notices by Dice coefficient over word bigrams, in SQL functions only."""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

# Short public licence notices, and full texts and headers.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
    **{x.stem: x.read_text() for x in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))},
}

WORD = r"([a-z0-9]+(?:\.+[a-z0-9]+)*)"


def normal(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:\.+[a-z0-9]+)*", text.lower())


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)})


def cues(known: list[tuple[str, list[str]]], least: float) -> list[str]:
    """Words of which every unit or run that any template fits holds one: a
    fit has least / (2 - least) of the template's bigrams, and fewer are left
    without these words.  Long words and words of several templates first."""
    out: list[str] = []
    spread = Counter(w for _, grams in known for w in {w for b in grams for w in b.split(" ")})
    for _, grams in sorted(known, key=lambda x: len(x[1])):
        need = math.ceil(least / (2 - least) * len(grams) - 1e-9)
        left = [b for b in grams if not set(b.split(" ")) & set(out)]
        while left and len(left) >= need:
            touched = Counter(w for b in left for w in set(b.split(" ")))
            word = max(touched, key=lambda w: (len(w) > 5 or "." in w, spread[w] if len(w) > 5 else 0, touched[w], w))
            out.append(word)
            left = [b for b in left if word not in b.split(" ")]
    return out


def pattern(words: list[str]) -> str:
    """A regular expression for texts with any of the words; they share their
    prefixes in a tree, which is tried where a word begins only."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def told(at: dict) -> str:
        if "" in at:
            return ""
        parts = [re.escape(c) + told(x) for c, x in sorted(at.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return f"(?:^|[^a-z0-9]){told(tree)}"


def let(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def apart(runs: Column) -> Column:
    """Of runs with first and last, in order, those that meet none before."""
    return F.aggregate(runs, F.slice(runs, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: (x["first"] <= y["last"]) & (y["first"] <= x["last"])), kept).otherwise(F.concat(kept, F.array(x))))


def best_of(grams: Column, shape: Column, least: float) -> Column:
    """Struct (less, license) of the best template for distinct bigrams."""
    n = F.size(grams)
    fits = F.filter(shape, lambda t: (t["n"] >= F.lit(least / (2 - least)) * n - 1e-9) & (t["n"] <= F.lit((2 - least) / least) * n + 1e-9))
    return F.array_min(F.transform(fits, lambda t: F.struct((-2.0 * F.size(F.array_intersect(grams, t["grams"])) / (n + t["n"])).alias("less"), t["license"].alias("license"))))


def pairs(words: Column) -> Column:
    return F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda x, i: F.concat(F.get(words, i), F.lit(" "), x))


def fitting(grams: Column, t: Column, least: float) -> Column:
    """The runs of bigrams that fit template t, apart: struct of less_common,
    less, license, first, last.

    A run's Dice is at its best between two of the template's bigrams, from
    one that follows no other.  Other bigrams count each time they occur while
    the ends are sought."""
    hits = F.filter(F.transform(grams, lambda g, i: F.struct(i.alias("pos"), F.array_position(t["grams"], g).alias("id"))), lambda x: x["id"] > 0)

    def dated(h: Column) -> Column:
        ids = F.transform(h, lambda x: x["id"])
        before = lambda i, k: let(F.array_position(F.reverse(F.slice(i, 1, k)), F.get(i, k)), lambda p: F.when(p > 0, k - p).otherwise(F.lit(-1).cast("long")))
        return let(ids, lambda i: F.transform(h, lambda x, k: F.struct(x["pos"].alias("pos"), before(i, k).alias("prev"))))

    def run_from(h: Column, s: Column) -> Column:
        first = F.get(h, s)["pos"]
        state = F.struct(F.lit(0).alias("k"), F.lit(0).alias("c"), F.lit(0.0).alias("dice"), F.lit(0).alias("last"))

        def step(a: Column, x: Column) -> Column:
            c = a["c"] + F.when(x["prev"] < s, 1).otherwise(0)
            dice = F.lit(2.0) * c / (c + x["pos"] - first - a["k"] + t["n"])
            return let(F.struct(c.alias("c"), dice.alias("dice")), lambda b: F.struct((a["k"] + 1).alias("k"), b["c"].alias("c"), F.greatest(a["dice"], b["dice"]).alias("dice"), F.when(b["dice"] > a["dice"], x["pos"]).otherwise(a["last"]).alias("last")))

        part = F.slice(h, s + 1, t["most"])
        return let(F.aggregate(part, state, step), lambda a: F.struct((-a["dice"]).alias("less"), first.alias("first"), a["last"].alias("last")))

    def runs(h: Column) -> Column:
        starts = F.filter(F.transform(h, lambda x, k: F.when((k == 0) | (F.get(h, k - 1)["pos"] < x["pos"] - 1), k)), lambda k: k.isNotNull())
        return F.array_sort(F.filter(F.transform(starts, lambda s: run_from(h, s)), lambda x: x["less"] <= -least + 1e-12))

    def exact(x: Column) -> Column:
        own = F.array_distinct(F.slice(grams, x["first"] + 1, x["last"] - x["first"] + 1))
        both = F.struct(F.size(own).alias("n"), F.size(F.array_intersect(own, t["grams"])).alias("c"))
        return let(both, lambda b: F.struct((-b["c"]).alias("less_common"), (F.lit(-2.0) * b["c"] / (b["n"] + t["n"])).alias("less"), t["license"].alias("license"), x["first"].alias("first"), x["last"].alias("last")))

    return let(let(hits, dated), lambda h: let(runs(h), lambda r: F.transform(apart(r), exact)))


def inside(docs: DataFrame, shape: Column, least: float) -> DataFrame:
    """Notices that stand in a run of words and not in lines of their own."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(1)))
    out = docs.select("doc_id", F.explode(F.array(lines)).alias("lines"))
    out = out.select("doc_id", "lines", F.explode(F.array(F.struct(F.flatten("lines").alias("words"), F.flatten(F.transform("lines", lambda w, i: F.transform(w, lambda _: i))).alias("at")))).alias("x"))
    out = out.select("doc_id", "lines", "x.at", F.explode(F.array(pairs(F.col("x.words")))).alias("grams"))
    out = out.select("doc_id", "lines", "at", "grams", F.explode(F.array(F.array_distinct("grams"))).alias("own"))
    need = lambda t: F.lit(least / (2 - least)) * t["n"] - 1e-9
    near = F.filter(shape, lambda t: (F.size("own") >= need(t)) & (F.size(F.array_intersect("own", t["grams"])) >= need(t)))
    out = out.select("doc_id", "lines", "at", "grams", "own", F.explode(F.array(near)).alias("near")).where(F.size("near") > 0)
    found = F.array_sort(F.flatten(F.transform("near", lambda t: fitting(F.col("grams"), t, least))))
    out = out.select("doc_id", "lines", "at", "own", F.explode(F.array(found)).alias("found")).where(F.size("found") > 0)
    best = best_of(F.col("own"), shape, least)
    whole = F.when((F.size("lines") > 1) & (best["less"] <= -least + 1e-12), best["license"])
    out = out.select("doc_id", "lines", "at", F.explode(F.array(F.struct(whole.alias("license"), apart(F.col("found")).alias("found")))).alias("x"))
    out = out.select("doc_id", "lines", "at", F.col("x.license").alias("whole"), F.inline("x.found"))
    out = out.withColumn("line", F.get("at", F.col("first"))).withColumn("end", F.get("at", F.col("last") + 1))
    told = lambda w: let(F.array_distinct(pairs(w)), lambda g: F.coalesce(best_of(g, shape, least)["less"], F.lit(0.0)) <= -least + 1e-12)
    mine = F.slice("lines", F.col("line") + 1, F.col("end") - F.col("line") + 1)
    out = out.where(~F.coalesce(F.col("whole") == F.col("license"), F.lit(False)) & ~F.forall(F.filter(mine, lambda w: F.size(w) > 0), told))
    return out.select("doc_id", "line", "license", (-F.col("less")).alias("dice"))


def scan(docs: DataFrame, least: float = 0.8, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for every line (and every text of more than one line) that is a
    licence notice, and for every run of words that is one across or inside
    other lines: doc_id, line (from 0; -1 for the whole text; of a run its
    first), license, dice.

    Words are lowered runs of a-z, 0-9 and inner dots.  A unit's best
    template counts if twice the common bigrams over the sum of both numbers
    of distinct bigrams is at least ``least``; ties go to the smaller name.
    Texts without any word that such a unit must hold (see ``cues``) are
    passed over, then units with too few words, or too many distinct ones, for
    any template before their bigrams are made, and templates whose size
    excludes them before they are compared.

    Of runs that meet, the one with most common bigrams stays, and of one
    template's the one with the higher dice; runs in lines that are all
    reported themselves, and of the licence that the whole text is reported
    for, are not told again.  A run has at most 1.5 times the template's
    bigrams, with repeats.

    Null and empty texts have no units.  Repeated rows repeat.  A null doc_id
    is reported as it is; other columns are ignored; an empty table gives an
    empty result."""
    known = sorted((name, bigrams(normal(text))) for name, text in (templates or TEMPLATES).items())
    sizes = [len(b) for _, b in known]
    most = {name: math.ceil((2 - least) / least * len(normal(text))) for name, text in (templates or TEMPLATES).items()}
    shape = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(len(b)).alias("n"), F.lit(most[name]).alias("most"), F.split(F.lit(",".join(b)), ",").alias("grams")) for name, b in known))
    lo, hi = least / (2 - least) * min(sizes), (2 - least) / least * max(sizes)
    # few texts are left, and read twice
    docs = written(docs.select("doc_id", "text").where(F.lower("text").rlike(pattern(cues(known, least)))))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("unit")))
    whole = F.when(F.contains("text", F.lit("\n")), F.array(F.struct(F.lit(-1).alias("line"), F.col("text").alias("unit")))).otherwise(F.array().cast("array<struct<line:int,unit:string>>"))
    units = docs.select("doc_id", F.inline(F.concat(whole, lines)))
    # a unit of w words has at most w - 1 bigrams, and at least one for each
    # distinct word but the first
    count = F.regexp_count(F.lower("unit"), F.lit(r"[a-z0-9]+(\.+[a-z0-9]+)*"))
    units = units.withColumn("w", count).where(F.col("w") > int(lo))
    words = F.regexp_extract_all(F.lower("unit"), F.lit(WORD), F.lit(1))
    units = units.select("doc_id", "line", "w", F.explode(F.array(words)).alias("words"))
    units = units.where((F.col("w") <= int(hi) + 1) | (F.size(F.array_distinct("words")) <= int(hi) + 1))
    units = units.select("doc_id", "line", F.explode(F.array(F.array_distinct(pairs(F.col("words"))))).alias("grams"))
    best = units.withColumn("best", best_of(F.col("grams"), shape, least)).where(F.col("best.less") <= -least + 1e-12)
    return best.select("doc_id", "line", "best.license", (-F.col("best.less")).alias("dice")).union(inside(docs, shape, least))


def query(spark, sf_dir: str) -> DataFrame:
    """Every licence notice in documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
