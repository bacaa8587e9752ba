"""Every operator and stage on one table with null ids and texts, repeated
rows, ties, one very long text and columns with the operators' own names."""

import collections
import math
import random
import re

import pytest

from citeflow.llm import context_tree, decontaminate, fingerprints, licenses, line_dedup, mixing, ngram_join, substring_dedup, toxicity, url_filter

CLASHES = "_key _lost _h _s _n _b _words _id _block _times key row id lost size s b h n said first none prev p graph label doc leaf body template seed item shift mix_odd".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
ITEM = " ".join(f"bench{i}" for i in range(20))


def table():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    same, long_ = say(70), say(200_000)
    texts = [(1, same), (1, same), (1, same), (2, same), (None, same), (None, same), (None, None), (3, None), (3, None), (4, ""), (4, ""), (5, " \n\t "), (6, "one"), (7, "ONE")]
    texts += [(8, long_), (9, " ".join(long_.split()[:150_000]) + " " + say(10)), (10, say(60)), (10, say(60)), (2**63 - 1, say(60)), (-5, say(50) + "\nshared line of some\n" + ITEM)]
    texts += [(20 + i, say(40) + "\nshared line of some\nAll rights reserved.") for i in range(6)]
    return [(k, t, None if i % 3 else "en", [None, "a", "b"][i % 3], None if t is None else len(t), *(f"{c}{i}" for c in CLASHES)) for i, (k, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    # equal rows are equal in every column
    first = {}
    return [first.setdefault(r[:2], r) for r in table()]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(1, 26)] + [(20, 2), (None, 1), (21, None)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_fingerprints(docs, rows):
    got = fingerprints.edited(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(r[0]), len(r[1] or "")) for r in rows)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["fingerprint"])
    assert by[1] == by[2] <= by[None] and by[3] == by[4] and by[6] != by[7]
    long_ = next(r for r in got if r["doc_id"] == 8)
    assert 0.6 < long_["near_edited"] < 0.95 and 0.75 < long_["near_next"] < 0.98  # 3/4 and about 0.87 are the same


def test_likeness_follows_overlap(spark):
    rng = random.Random(1)
    for n in (1000, 100_000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for share in (0.0, 0.25, 0.5, 0.75, 1.0):
            other = base[: int(n * share)] + [f"v{rng.randrange(10**6)}" for _ in range(n - int(n * share))]
            two = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")
            near = {r["doc_id"]: r["near_next"] for r in fingerprints.edited(two).collect()}
            assert near[1] == pytest.approx(share, abs=0.35) and near[1] == pytest.approx(near[2])


def test_fingerprints_add_up(spark):
    texts = ["a b c d e", "f g h", "a b c d e\nf g h", "f g h\na b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, body string")
    got = {r["k"]: r["print"] for r in fingerprints.fingerprints(df, ["k"]).collect()}
    both = [(a + b) % (1 << 32) for a, b in zip(got[0]["exact"], got[1]["exact"], strict=True)]
    assert got[2]["exact"] == got[3]["exact"] == both  # insertion, and any order
    assert [(a - b) % (1 << 32) for a, b in zip(got[2]["exact"], got[0]["exact"], strict=True)] == got[1]["exact"]  # deletion
    assert got[2]["packed"] == got[3]["packed"] == [a + b for a, b in zip(got[0]["packed"], got[1]["packed"], strict=True)]


def test_context_tree(docs, rows):
    got = context_tree.score(docs, block_bytes=100_000).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(r[0]), len(split(r[1])) + 1) for r in rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got) and all(r["held_out"] for r in got if r["doc_id"] is None)
    train = sum(len(split(r[1])) + 1 for r in rows if r[0] is not None and __import__("zlib").crc32(str(r[0]).encode()) % 10)
    assert {r["train_tokens"] for r in got} == {train}


def test_decontamination(docs, spark, tables, rows):
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    assert [tuple(r) for r in decontaminate.overlaps(docs, bench).collect()] == [(-5, 1, 54, 20, 20)] * 2
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(map(repr, map(tuple, kept.collect()))) == sorted(repr(r) for r in rows if r[0] != -5)


def test_ngram_join(docs, rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for r in rows:
        w = split((r[1] or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    lowest = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if None not in (rows[i][0], rows[j][0]) and a and b and (rows[i][0] == rows[j][0] or 100 * len(a & b) >= 75 * len(a | b)) and lowest[i] > lowest[j]:
                    lowest[i], changed = lowest[j], True
    got = sorted(repr(tuple(r)) for r in ngram_join.join(docs, block_bytes=100_000).collect())
    assert got == sorted(repr((r[0], len(s), m)) for r, s, m in zip(rows, sets, lowest, strict=True))


def test_many_copies(spark, monkeypatch):
    """Over 64 near copies of one text, and a chain of over 128 sets in which
    only neighbours link, searched whole and list by list."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((1000 + i, " ".join(w)))
    chain = [word() for _ in range(150 * 8 + 100)]
    rows += [(5000 + i, " ".join(chain[8 * i : 8 * i + 90])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {k: 1000 if k < 5000 else 5000 for k, _ in rows}
    for asks, group in ((1024, 128), (16, 8)):
        monkeypatch.setattr(ngram_join, "ASKS", asks)
        monkeypatch.setattr(ngram_join, "GROUP", group)
        assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(df, block_bytes=20_000).collect()} == want


def test_licenses(docs):
    got = licenses.scan(docs).collect()
    assert sorted((r["doc_id"], r["line"], r["license"], r["dice"]) for r in got) == [(20 + i, 2, "all-rights-reserved", 1.0) for i in range(6)]


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and set(docs.columns) <= set(mixing.mix(docs).columns)
    for s in (None, "a", "b"):
        own = [r for r in got if r["source"] == s]
        assert sum(r["mix_size"] for r in own) == own[0]["mix_source_size"]
        assert abs(sum(r["mix_taken"] for r in own) - own[0]["mix_target"]) <= max(r["mix_size"] for r in own) / 2 + 1
        assert all(r["mix_taken"] == r["mix_size"] * r["mix_copies"] <= 2 * r["mix_size"] for r in own)
    assert all(r["mix_copies"] == 0 for r in got if not split(r["text"]))


def test_mixing_equal_rows(spark):
    rows = [(1, "a b c", "x")] * 1000 + [(i, "w " * (i % 30 + 1), ["y", None][i % 2]) for i in range(2, 200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    own = [r for r in got if r["source"] == "x"]
    assert len(own) == 1000 and abs(sum(r["mix_taken"] for r in own) - own[0]["mix_target"]) <= 1.5
    assert sorted({r["mix_copies"] for r in own}) == [1, 2]


def test_mixing_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 16)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 5)
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 9), f"s{rng.randrange(100):02d}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=6).collect()
    sizes = collections.Counter()
    for r in got:
        for x in r["mix_shards"]:
            sizes[x] += 1
        assert len(r["mix_shards"]) == r["mix_copies"]
    assert sorted(sizes) == list(range(6)) and max(sizes.values()) < 1.3 * min(sizes.values())
    total = {s: sum(r["mix_size"] for r in got if r["source"] == s) for s in {r["source"] for r in got}}
    assert sum({r["source"]: r["mix_target"] for r in got}.values()) == pytest.approx(1.5 * sum(total.values()))
    for s in total:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["mix_taken"] for r in own) - own[0]["mix_target"]) <= 4.5 + 1e-6


def test_split_tree():
    import numpy as np

    quotas = np.array([40, 0, 7, 200, 1])
    mean = np.zeros((5, 5))
    for seed in range(400):
        got = mixing.split_tree(quotas, mixing.even(248, 5), np.random.default_rng(seed))
        assert (got.sum(0) == quotas).all() and got.sum(1).tolist() == mixing.even(248, 5).tolist() and (got >= 0).all()
        mean += got / 400
    # each shard's expected share of a source is its share of all draws
    assert np.abs(mean - np.outer(mixing.even(248, 5) / 248, quotas)).max() < 1.0


def test_substrings(docs, rows):
    count = collections.Counter()
    for r in rows:
        w = split(r[1])
        count.update(hash(tuple(w[i : i + 35])) for i in range(len(w) - 34))
    want = []
    for r in rows:
        w = split(r[1])
        gone = [0] * (len(w) + 1)
        for i in range(len(w) - 34):
            if count[hash(tuple(w[i : i + 35]))] > 1:
                gone[i] += 1
                gone[i + 35] -= 1
        depth, n = 0, 0
        for x in gone[:-1]:
            depth += x
            n += depth > 0
        want.append((str(r[0]), len(w), n))
    got = substring_dedup.remove_repeats(docs, block_bytes=100_000).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in got) == sorted(want)


def test_toxicity(docs, spark, tables, rows):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    got = toxicity.score(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1 == len({r["score"] for r in got if r["doc_id"] in (3, 4)})
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_lines(docs, rows):
    out = line_dedup.drop_recurring(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""), tuple(r)[5:]) for r in out.collect())
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["text"] for r in out.collect() if (r["doc_id"] or 0) >= 20}
    assert "shared line of some" in next(r["text"] for r in out.collect() if r["doc_id"] == -5)
    assert kept[20].endswith("\nAll rights reserved.") and "shared" not in kept[20]
    assert all(kept[20 + i].count("\n") == 0 for i in range(1, 6))
    for r in out.collect():
        if r["text"] is not None:
            assert r["n_chars"] == len(r["text"])


def test_lines_count_documents(spark):
    a = "red green blue teal pink".split()
    two = [(i, "\n".join(f"very same line of {x} words" for x in a) + f"\nown{'ab'[i]} line") for i in range(2)]
    got = line_dedup.drop_recurring(spark.createDataFrame(two, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == two


def test_lines_against_brute_force(spark):
    """The definition, line by line: leaf, fixed and variable words, template,
    and its documents."""
    rng = random.Random(12)
    rows = []
    for i in range(60):
        lines = [f"the user {rng.choice(['ann', 'bob', f'name{chr(97 + i % 26)}x'])} has logged in to site {rng.choice('abc')} page {rng.randint(1, 99)} today" for _ in range(2)]
        lines += [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5))), "footer of site", f"only here {'xyz'[i % 3]}{'abcdefghij'[i % 10]} in text number {'klmnopqrst'[i // 6]}"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))

    def words_of(line):
        w = split(line)
        varies = [bool(re.search("[0-9]", x)) for x in w]
        return tuple(None if v and not (all(varies) and len(w) <= 3) else x for x, v in zip(w, varies, strict=True))

    parsed = [(k, j, words_of(x)) for k, t in rows for j, x in enumerate(t.split("\n"))]
    leaves, kinds = collections.Counter(), {(k, w) for k, _, w in parsed if w}
    for k, w in kinds:
        leaves[len(w), w[:3]] += 1
    common = collections.Counter((len(w), w[:3], p, w[p]) for k, w in kinds for p in range(3, len(w)) if w[p] is not None)

    def template(w):
        if not w or leaves[len(w), w[:3]] < 4:
            return None
        shape = tuple(x if p < 3 or x is None or common[len(w), w[:3], p, x] >= 4 else "*" for p, x in enumerate(w))
        return shape if shape.count("*") <= 0.2 * len(w) + 1e-9 else None

    found = collections.defaultdict(set)
    for k, _, w in parsed:
        found[template(w)].add(k)
    lost = {(k, j) for k, j, w in parsed if template(w) and len(found[template(w)]) >= 4 and k != min(found[template(w)])}
    want = {k: "\n".join(x for j, x in enumerate(t.split("\n")) if (k, j) not in lost) for k, t in rows}
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and lost


def test_urls(spark):
    urls = [None, "", "no url", "http://a.com/de/1", "http://a.com/de/1", "http://b.com/fr/" + "x" * 100_000, "http://c.net/de/?q=1", "ftp://Q.ORG"] * 4
    df = spark.createDataFrame([(None if i % 5 == 0 else i, u, "x", "y", "z", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, path string, hit string, score double")
    got = url_filter.judge(df, trees=2).collect()
    assert len(got) == len(urls) and sum(r["page_id"] is None for r in got) == 7
    assert {r["verdict"] for r in got if r["rule"] == "com/de/"} == {"block"} and {r["verdict"] for r in got} == {"allow", "block"}


def test_url_trees(spark):
    """The trees learn what rules say: here long paths with digits are blocked."""
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        bad = i % 3 == 0
        tail = "".join(rng.choice("0123456789") for _ in range(12)) if bad else "".join(rng.choice("abcdefgh") for _ in range(6))
        rows.append((f"http://h{i % 7}.com/{tail}", f"h{i % 7}.com", f"/{tail}", float(bad)))
    df = spark.createDataFrame(rows, "url string, host string, path string, label double")
    vectors, model = url_filter.fit(df.limit(800), trees=5)
    got = model.transform(vectors(df)).select("label", "prediction").collect()
    assert sum(r["label"] == r["prediction"] for r in got) > 0.98 * len(got)


def test_stages(spark, docs, rows, tables):
    import corpus_pipeline

    done = {name: stage(spark, docs, tables) for name, stage in corpus_pipeline.STAGES}
    for name, df in done.items():
        assert df.columns[: len(docs.columns)] == docs.columns, name
        assert df.count() > 0 and done[name].limit(0).columns == df.columns
    kept = collections.Counter((r["doc_id"], r["text"]) for r in done["ngram_jaccard"].collect())
    same = rows[0][1]
    assert kept[1, same] == 1 and not kept[2, same] and not kept[None, same]
    assert kept[3, None] == 2 and kept[4, ""] == 2 and kept[None, None] == 1  # without words
    assert sum(n for (k, _), n in kept.items() if k == 10) == 1 and not kept[7, "ONE"] and kept[6, "one"] == 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tables).count() == 0, name


def test_pipeline_run(spark, docs, tables):
    import corpus_pipeline

    docs.write.mode("overwrite").parquet(f"{tables}/documents.parquet")
    out = corpus_pipeline.run(spark, tables).collect()
    again = corpus_pipeline.run(spark, tables).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, map(tuple, again))) and out
    assert not {-5} & {r["doc_id"] for r in out} and all(0 <= r["mix_shard"] < mixing.SHARDS for r in out)
    assert max(collections.Counter((r["doc_id"], r["text"]) for r in out).values()) <= 2


def test_lanes(docs, monkeypatch):
    """Blocks that reach their ranges over lanes get the same answers."""
    from citeflow.llm import blocks

    run = lambda: [sorted(map(repr, map(tuple, f(docs, block_bytes=60_000, range_bytes=20_000).collect()))) for f in (substring_dedup.remove_repeats, ngram_join.join, context_tree.score)]
    direct = run()
    monkeypatch.setattr(blocks, "DIRECT", 2)
    assert run() == direct
