"""Corpus operators against brute force, on a small table with every edge case."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest

from citeflow.llm import context_tree, decontaminate, fingerprints, licenses, line_dedup, mixing, ngram_join, oracles, substring_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _block int, key string, n string"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def table():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abdeiorstü") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [None, "", "  \n ", "One", "one", "two words", say(30000)]
    for _ in range(12):
        t = say(rng.randint(60, 200))
        w = t.split()
        near = [*w]
        near[rng.randrange(len(w))] = "changed"
        texts += [t, t, " ".join(near), say(40) + "\n" + " ".join(w[:50])]
    texts += [say(80) for _ in range(20)]
    return [(i, t, None if i % 7 == 0 else "en", [None, "b", "a"][i % 3], None if t is None else len(t), 1, "k", "n") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings(docs, none):
    rows = table()
    count = collections.Counter()
    for r in rows:
        w = split(r[1])
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, block_bytes=20_000).collect()}
    for r in rows:
        w = split(r[1])
        gone = set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        g = got[r[0]]
        assert (g["n_words"], g["n_removed"], g["kept"]) == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
        assert {x for a in g["removed"] for x in range(a["first"], a["end"])} == gone
    assert substring_dedup.remove_repeats(none).count() == 0


def test_large_batch_after_small(spark):
    """Blocks whose messages and results have less than 4 MB, then more, in one task."""
    rng = random.Random(6)
    say = lambda n: " ".join(map(str, rng.choices(range(10**6, 10**7), k=n)))
    texts = [say(60) for _ in range(60)] + [say(600_000) for _ in range(2)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["doc_id"]: tuple(r)[1:4] for r in substring_dedup.remove_repeats(df, block_bytes=1 << 20).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    assert got == {i: (60, 60, "") if i in (0, 62) else (len(t.split()), 0, t) for i, t in enumerate([*texts, texts[0]])}


def sets_of(rows):
    out = {}
    for r in rows:
        w = split((r[1] or "").translate(LOW))
        out[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    return out


def test_ngram_join(docs, none):
    s = sets_of(table())
    best = {k: k for k in s}
    changed = True
    while changed:
        changed = False
        for a in s:
            for b in s:
                if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]) and best[a] != best[b]:
                    best[a] = best[b] = min(best[a], best[b])
                    changed = True
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs, block_bytes=20_000).collect()}
    assert got == {k: (len(s[k]), best[k]) for k in s}
    assert ngram_join.join(none).count() == 0


def test_divide_skip():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 20))) for _ in range(rng.randint(1, 15))]
        need = rng.randint(1, len(lists))
        n = collections.Counter(x for y in lists for x in y)
        assert ngram_join.divide_skip(lists, need) == sorted(k for k, v in n.items() if v >= need)


def test_context_tree(docs, none):
    rows = table()
    words = {r[0]: [*split((r[1] or "").translate(LOW)), None] for r in rows}
    c = collections.Counter(x for k, w in words.items() if zlib.crc32(str(k).encode()) % 10 for x in w)
    n, v = sum(c.values()), len(c)
    texts = [(r[1] or "").translate(LOW).encode() for r in rows]
    counts = collections.defaultdict(lambda: [0, 0])

    def path(t, i):
        before = ([255] * 5 + list(t[:i]))[-5:][::-1]
        byte = t[i] if i < len(t) else 255
        for b in range(8):
            yield (1 << b) | byte >> (8 - b), byte >> (7 - b) & 1, before

    for r, t in zip(rows, texts, strict=True):
        if zlib.crc32(str(r[0]).encode()) % 10:
            for i in range(len(t) + 1):
                for z, bit, before in path(t, i):
                    for d in range(6):
                        counts[z, tuple(before[:d])][bit] += 1
    kids = collections.defaultdict(list)
    for z, ctx in counts:
        if ctx:
            kids[z, ctx[:-1]].append((z, ctx))
    kt = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in counts.items()}
    weighted, share = {}, {}
    for k in sorted(counts, key=lambda k: -len(k[1])):
        if len(k[1]) == 5:
            weighted[k], share[k] = kt[k], 1.0
        else:
            rest = sum(weighted[x] for x in kids[k])
            m = max(kt[k], rest)
            weighted[k] = math.log(0.5) + m + math.log(math.exp(kt[k] - m) + math.exp(rest - m))
            share[k] = math.exp(math.log(0.5) + kt[k] - weighted[k])

    def chance(z, before):
        p, w = 0.0, 1.0
        for d in range(6):
            k = z, tuple(before[:d])
            if k not in counts:
                return p + w / 2
            p, w = p + w * share[k] * (counts[k][1] + 0.5) / (sum(counts[k]) + 1), w * (1 - share[k])
        return p

    got = {r["doc_id"]: r for r in context_tree.score(docs, block_bytes=20_000).collect()}
    for r, t in zip(rows, texts, strict=True):
        g = got[r[0]]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in words[r[0]])
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(words[r[0]]), sum(c[x] > 0 for x in words[r[0]]), n)
        assert g["base_score"] == pytest.approx(base)
        if len(t) < 1500:
            want = 0.0
            for i in range(len(t) + 1):
                for z, bit, before in path(t, i):
                    p = chance(z, before)
                    want += math.log10(p if bit else 1 - p)
            assert g["score"] == pytest.approx(want, rel=1e-4)
    assert context_tree.score(none).count() == 0


def test_fingerprints(docs, none, spark):
    rows = [(r[0], r[1] or "") for r in table()]
    got = {r["doc_id"]: r for r in fingerprints.edited(docs).collect()}
    assert len(got) == len(rows)
    for i, (k, t) in enumerate(rows):
        n = len(t) // 4
        new = t[: len(t) - n] + rows[(i + 1) % len(rows)][1][:n]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert got[k]["near_edited"] == 1.0 or t != new
    by = collections.defaultdict(set)
    for k, t in rows:
        by[t].add(got[k]["fingerprint"])
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)
    two = spark.createDataFrame([(1, "a b c d\ne f g"), (2, "e f g\na b c d")], "doc_id long, text string")
    assert len({r["fingerprint"] for r in fingerprints.edited(two).collect()}) == 1
    assert fingerprints.edited(none).count() == 0
    assert fingerprints.edited(two.union(two)).count() == 4


def test_fingerprints_of_long_texts(spark):
    line = "one two three four five six seven eight nine ten"
    texts = ["\n".join([line] * 10_000), " ".join(f"w{i}" for i in range(2000))]
    got = {r["doc_id"]: r for r in fingerprints.edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["near_edited"] > 0.99 and got[0]["near_next"] < 0.5


def test_decontamination(docs, none, spark):
    rng = random.Random(9)
    item = " ".join(f"q{rng.randrange(999)}x{i}" for i in range(30))
    swapped = item.split()
    for i in (6, 14, 23):
        swapped[i] = "other"
    extra = spark.createDataFrame([(900, "start " + item.upper() + " end"), (901, "x " + " ".join(swapped)), (902, "tiny one here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "tiny one here"), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_same"] for r in decontaminate.overlaps(docs.select("doc_id", "text").union(extra), bench).collect()}
    assert got == {(900, 1): 30, (901, 1): 27, (902, 3): 3}
    assert decontaminate.keep_clean(docs.select("doc_id", "text").union(extra), bench).count() == docs.count()
    assert decontaminate.overlaps(none, bench).count() == 0 == decontaminate.overlaps(docs, bench.limit(0)).count()


def test_decontamination_masks():
    import itertools

    import numpy as np

    def holds(runs, n, masks):
        out = np.zeros(len(runs), bool)
        for m in masks:
            for s in range(n - len(m) + 1):
                out |= (runs >> s) & int(m, 2) == int(m, 2)
        return out.all()

    def runs(n, need):
        most = min(n - need, n // 4)
        return np.array([(1 << n) - 1 - sum(1 << i for i in z) for k in range(most + 1) for z in itertools.combinations(range(1, n - 1), k)])

    # every overlap of up to 27 words that begins and ends with a same word
    assert all(holds(runs(n, 10), n, decontaminate.MASKS) for n in range(10, 28))
    for size in range(1, 13):
        need = decontaminate.need_of(size, 10, 0.75)
        assert all(holds(runs(n, need), n, decontaminate.masks_of(size, 10, 0.75)) for n in range(need, size + 1))


def overlaps_of(spark, pairs, least=10, share=0.75):
    """Best overlaps of (doc words, item words) pairs, each with words of its
    own, from one run of the operator."""
    own = [([f"c{i}{x}" for x in d], [f"c{i}{x}" for x in t]) for i, (d, t) in enumerate(pairs)]
    docs = spark.createDataFrame([(i, " ".join(d)) for i, (d, _) in enumerate(own)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(t)) for i, (_, t) in enumerate(own)], "item_id long, text string")
    got = {}
    for r in decontaminate.overlaps(docs.repartition(3), items, least, share).collect():
        assert r["doc_id"] == r["item_id"]
        got[r["doc_id"]] = (r["first"], r["n_words"], r["n_same"])
    return [got.get(i) for i in range(len(pairs))]


def brute(doc, item, least=10, share=0.75):
    """The most same words of any run at any place that counts, or None."""
    need, best = min(least, math.ceil(share * len(item) - 1e-9)), None
    for shift in range(-len(item) + 1, len(doc)):
        lo, hi = max(0, shift), min(len(doc), shift + len(item))
        same = [doc[k] == item[k - shift] for k in range(lo, hi)]
        for a in range(len(same)):
            n = 0
            for b in range(a, len(same)):
                n += same[b]
                if n >= max(1, need) and n >= share * (b - a + 1) - 1e-9:
                    best = max(best or 0, n)
    return best


def test_decontamination_against_brute_force(spark):
    rng, pairs = random.Random(11), []
    for n in (*range(3, 17), 20, 24, 30, 40, 60):
        for _ in range(12):
            item = [f"q{i}x" for i in range(n)]
            rate = rng.choice([0, 0.1, 0.2, 0.25, 0.3])
            part = item[: rng.randint(max(1, n // 2), n)] if rng.random() < 0.5 else item
            doc = [f"o{i}x" if rng.random() < rate else x for i, x in enumerate(part)]
            pairs.append(([*(f"l{i}x" for i in range(rng.randint(0, 6))), *doc, *(f"r{i}x" for i in range(rng.randint(0, 6)))], item))
    got, want = overlaps_of(spark, pairs), [brute(*p) for p in pairs]
    assert [g and g[2] for g in got] == want and sum(x is not None for x in want) > 100
    assert all(g is None or g[2] >= 0.75 * g[1] for g in got)


def test_decontamination_sparse(spark):
    w, other = [f"q{i}x" for i in range(64)], [f"o{i}x" for i in range(64)]
    runs = [([*other[:20], *w[7 : 7 + n], *other[20:40]], w) for n in range(8, 13)]
    assert overlaps_of(spark, runs) == [None, None, (20, 10, 10), (20, 11, 11), (20, 12, 12)]
    sparse = [([other[i] if i % 4 == phase else w[i] for i in range(n)], w[:n]) for n in (16, 20, 30, 42, 60) for phase in range(4)]
    assert [x[2] for x in overlaps_of(spark, sparse)] == [sum(i % 4 != phase for i in range(n)) for n in (16, 20, 30, 42, 60) for phase in range(4)]
    # shorter items: three quarters of their words, up; a longer overlap hides nothing
    long_ = [x if i < 14 or i % 5 in (0, 2, 4) else "other" for i, x in enumerate(w[:50])]
    short = [(["z", *w[:3], "z", *w[4:7], "z", *w[8:11], "z"], w[:12]), ([*w[:2], "z", *w[3:5], "z", *w[6:8]], w[:8]), (long_, w[:50])]
    a, b, c = overlaps_of(spark, short)
    assert (a, b) == ((1, 11, 9), (0, 8, 6)) and c[0] == 0 and c[2] >= 14


def test_licenses(docs, none, spark):
    texts = ["intro words\nReleased under the MIT license\n", "RELEASED UNDER THE MIT LICENSE!", "all rights reserved", None, "", "released under nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["line"], r["license"], round(r["dice"], 6)) for r in licenses.scan(df).collect())
    want = []
    for i, t in enumerate(texts):
        units = list(enumerate((t or "").split("\n"))) + ([(-1, t)] if t and "\n" in t else [])
        for k, u in units:
            a = set(licenses.bigrams(licenses.normal(u)))
            best = min(((-2 * len(a & set(b)) / (len(a) + len(b)), name) for name, b in ((n, licenses.bigrams(licenses.normal(x))) for n, x in licenses.TEMPLATES.items()) if a), default=(0, ""))
            if best[0] <= -0.8:
                want.append((i, k, best[1], round(-best[0], 6)))
    assert got == sorted(want) and got
    assert licenses.scan(docs).count() == 0 == licenses.scan(none).count()


def test_licenses_inside(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    flat = lambda x: " ".join(x.split())
    texts = [
        "Some prose of its own comes first here.\n" + "".join(f"more{i} words{i} of{i}\n" for i in range(60)) + "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit + "\nand prose again\n" + "".join(f"other{i} words{i}\n" for i in range(60)),
        "This little package is released under the MIT License and comes with no support at all, sorry.",
        "See the notes below. Licensed under the Apache\nLicense, Version 2.0. More text follows here.",
        flat(licenses.TEMPLATES["MIT-text"].split("\n\n")[0]),
        "Nothing is released under a license of any kind here, and all rights are open.",
        "".join(f"Some{i} words{i} first. " for i in range(30)) + flat(licenses.TEMPLATES["Apache-2.0-header"]) + " Then it goes on. " * 9,
    ]
    got = sorted((r["doc_id"], r["line"], r["license"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == [(0, 65, "MIT-text"), (1, 0, "MIT"), (2, 0, "Apache-2.0"), (3, 0, "MIT-permission"), (5, 0, "Apache-2.0-header")]


def test_oracles(docs, spark):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(1000, "x\n" + "All rights reserved. " * 90), (1001, "licensed under CC BY 4.0.\nLicensed under the Apache License, version 2.0")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [x[0] for x in rows], "text": [x[1] for x in rows]}))
    cut = lambda d: [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in d.collect()]
    for got, sql in ((cut(substring_dedup.remove_repeats(df)), oracles.SUBSTRING_DEDUP), ([*map(tuple, ngram_join.join(df).collect())], oracles.NGRAM_JACCARD), ([*map(tuple, licenses.scan(df).collect())], oracles.LICENSES)):
        assert sorted(got) == sorted(con.sql(sql).fetchall()) and got


def targets(sizes, weights, share, most):
    """The contract's targets, source by source."""
    left, open_, out = share * sum(sizes), [i for i, n in enumerate(sizes) if n], [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else left * weights[i] / total
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    sizes = {r["doc_id"]: r["mix_size"] for r in got}
    assert sizes == {r[0]: len(split(r[1])) for r in table()}
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["mix_taken"] == r["mix_copies"] * r["mix_size"] <= 2 * r["mix_size"] and len(r["mix_shards"]) == r["mix_copies"]
    total = {s: sum(r["mix_size"] for r in x) for s, x in by.items()}
    assert sum(x[0]["mix_target"] for x in by.values()) == pytest.approx(1.5 * sum(total.values()))
    for s, x in by.items():
        assert abs(sum(r["mix_taken"] for r in x) - x[0]["mix_target"]) <= max(r["mix_size"] for r in x)
    again = {r["doc_id"]: r["mix_shards"] for r in mixing.mix(docs.repartition(2)).collect()}
    assert again == {r["doc_id"]: r["mix_shards"] for r in got}
    assert targets([10, 10, 100], [3, 1, 2], 1.5, 2) == [20, 20, 140]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = targets([total[s] for s in names], [[3, 1, 2][i % 3] for i in range(len(names))], 1.5, 2)
    assert [by[s][0]["mix_target"] for s in names] == pytest.approx(want)
    assert mixing.mix(none).count() == 0


def test_segments():
    import numpy as np

    rng = random.Random(2)

    def maximal(x, lo, hi):
        best = max(((round(sum(x[a:b]), 9), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = -best[2], -best[2] - best[1]
        return [*maximal(x, lo, a), (a, b, best[0]), *maximal(x, b, hi)]

    for _ in range(400):
        x = [rng.randint(-192, 160) / 64 for _ in range(rng.randint(1, 16))]  # exact sums
        got = [(a, b, round(s, 9)) for a, b, s in toxicity.segments(np.array(x))]
        assert got == maximal(x, 0, len(x))
    # linear: candidates that are never merged, and ones that always are
    for x in (np.tile([2.0, -3.0], 200_000), np.concatenate((np.tile([1.0, -2.0], 100_000), np.tile([2.0, -1.0], 200_000)))):
        assert sum(s for *_, s in toxicity.segments(x)) > 0


def test_toxicity(spark, none):
    rng = random.Random(4)
    base = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = [rng.choice(base) for _ in range(60)]
        bad = i % 5 == 1
        if bad:
            for j in range(4):
                w[20 + j] = rng.choice(["vile", "nasty", "grubby"]) + rng.choice(["", "er"])
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame([*rows, (990, None, None), (991, "", None)], "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert held and all(got[k]["predicted"] == y for k, _, y in held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[990]["score"] == got[991]["score"] < 0.5
    assert all(got[k]["passages"][0]["first"] in range(17, 24) for k, _, y in held if y)
    assert toxicity.score(none, df.select("doc_id", "toxic")).count() == 0
    assert {r["predicted"] for r in toxicity.score(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0)).collect()} == {0}


def test_lines(docs, none, spark):
    rows = [(i, f"own{i} text is here\nOrder number {i} was shipped today\nshared footer line of this site", i) for i in range(30)]
    df = spark.createDataFrame([*rows, (99, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(df).collect()}
    assert got[0] == rows[0][1] and got[99] is None
    assert all(got[i] == f"own{i} text is here" for i in range(1, 30)) or all(got[i] == "" for i in range(1, 30))
    same = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(docs).collect()}
    assert same == {r[0]: r[1] for r in table()}
    assert line_dedup.drop_recurring(none).columns == none.columns


def test_short_and_rarer_lines(spark):
    often = ["Done.", "All rights reserved.", "See page 7", "12 30", "one footer line of few documents"]
    rows = [(i, "\n".join([f"own {'abcdefgh'[i]}", "", *(often if i < 4 else []), f"{i} 1{i}", *(["in three documents only"] if i < 3 else [])])) for i in range(8)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {k: "\n".join(x for x in t.split("\n") if k == 0 or x not in often) for k, t in rows}
    assert got == want


def test_urls(spark):
    urls = [None, "", "nothing", "http://a.org", "HTTP://A.ORG/x?y#z", "http://example.org/es/1", "https://www.Example.org/en/12", "http://b.com/fr/1", "http://b.com/de/1", "http://badexample.org/es/1", "http://x.net/a?b=http://c.org/", "http://c.com?x/fr/", "http://org/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(df, trees=2).collect():
        u = urls[r["page_id"]] or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None), u
        assert r["verdict"] == max(fits)[2] if fits else r["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], (k, name)
    assert 0 < docs.count() < 200
