"""Hand-worked cases of the bibliometric operators."""

import pytest
from pyspark.sql import functions as F

from citeflow.functions import text as T
from citeflow.operators import enrichment, graph, impact, mapping, qualitative, trends
from citeflow.sources import extraction, readers, writers

WORKS = [
    (0, "A, B", "T0", "W1; W2; W3", 10.0, 2019.0), (1, "A", "T1", None, 5.0, 2019.0), (2, "A, C", "T2", "W2; W3; W3", 1.0, 2020.0),
    (3, None, "T3", "W3", None, 2020.0), (4, "B, B", None, "2019; Smith; x y", 0.0, None), (5, "A", "T5", "W1;W2", 101.0, 2021.0),
]


@pytest.fixture(scope="module")
def works(spark):
    return spark.createDataFrame(WORKS, "work_id long, author string, title string, refs string, cites double, pub_year double").cache()


def rows(df, *order):
    return sorted(tuple(r) for r in df.collect())


def test_author_metrics(works):
    got = {r["author"]: r for r in impact.author_metrics(works).collect()}
    assert [(got[a]["n_articles"], got[a]["total_citations"], got[a]["h_index"], got[a]["g_index"]) for a in "ABC"] == [(4, 117, 3, 4), (3, 10, 1, 3), (1, 1, 1, 1)]
    assert got["A"]["avg_citations"] == 29.25


def test_indices_on_random_lists(spark):
    import random

    random.seed(3)
    data = {f"a{i}": [random.choice([0, 1, 2, 3, 5, 8, 40]) for _ in range(random.randint(1, 30))] for i in range(60)}
    df = spark.createDataFrame([(k, a, float(c)) for k, (a, v) in enumerate(data.items()) for c in v], "work_id long, author string, cites double")
    for r in impact.author_metrics(df).collect():
        c = sorted(data[r["author"]], reverse=True)
        assert r["h_index"] == sum(x >= i + 1 for i, x in enumerate(c))
        assert r["g_index"] == max([i + 1 for i in range(len(c)) if sum(c[: i + 1]) >= (i + 1) ** 2], default=0)


def test_inequality(works):
    m = impact.author_metrics(works)
    assert impact.gini(m).first()[0] == pytest.approx(0.6041666)
    assert rows(impact.lorenz(m))[-1] == (1.0, 1.0) and rows(impact.lorenz(m))[0] == pytest.approx((1 / 3, 1 / 128))


def test_trends(works):
    assert rows(trends.header_metrics(works)) == [(3, 117, pytest.approx(23.4))]
    assert rows(trends.avg_cites_by_year(works)) == [(2019, 7.5), (2020, 0.5), (2021, 101.0)]
    assert rows(trends.uncited_by_year(works)) == [(2020, 1)]
    assert rows(trends.missing_summary(works)) == [(1, pytest.approx(100 / 6))]
    assert [r["title"] for r in trends.most_cited(works).collect()] == ["T5"]


def test_mapping(works):
    assert rows(mapping.ref_summary(works)) == [(10, 5, 1, pytest.approx(100 / 6))]
    assert rows(mapping.co_citation(works)) == [("W1", "W2", 2), ("W1", "W3", 1), ("W2", "W3", 2)]
    assert rows(mapping.coupling(works)) == [(0, 2, 2), (0, 3, 1), (0, 5, 2), (2, 3, 1), (2, 5, 1)]


def test_text(spark):
    df = spark.createDataFrame([(x,) for x in ["12", " 13 ", "1e3", "2020.7", "1,000", "x", "", "12d", "nan"]], "x string")
    assert [r[0] for r in df.select(T.number(F.col("x"))).collect()] == [12, 13, 1000, 2020.7, None, None, None, None, None]
    refs = "Smith 2019 J; 10.1/x; https://doi.org/10.1/x; W123; w9; Weber2010; 2019; Smith2019; 12 34; ;  W7　"
    got = spark.createDataFrame([(refs,)], "x string").select(T.references(F.col("x"))).first()[0]
    assert got == ["Smith 2019 J", "10.1/x", "https://doi.org/10.1/x", "W123", "w9", "Weber2010", "W7"]


def test_qualitative(spark):
    m = spark.createDataFrame([(0, "yes", "M0"), (1, "Title", "Paper A 2021"), (2, " SIM ", "BPMM"), (3, "no", "framework - X"), (4, None, "SCOR"), (5, "title", "Paper B"), (6, "title", "Paper A 2021"), (7, "no", "Not valid csv text")], "row_id long, status string, data string")
    found = qualitative.models(m)
    assert rows(found.select("model", "used", "year")) == [("BPMM", True, 2021), ("Framework", False, 2021), ("SCOR", False, 2021)]
    assert [r["article"] for r in qualitative.articles_without_models(m).collect()] == ["Paper B"]
    wide = m.select((F.col("row_id") * qualitative.SPAN).alias("row_id"), "status", "data")
    assert rows(qualitative.models(wide).select("model", "used", "year")) == rows(found.select("model", "used", "year"))


def test_graph(spark):
    path = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    got = {r["node"]: r for r in graph.centralities(path).collect()}
    assert got["a"]["closeness"] == pytest.approx(0.5) and got["b"]["closeness"] == pytest.approx(0.75)
    assert got["b"]["betweenness"] == pytest.approx(2 / 3) == got["c"]["betweenness"]
    assert sum(r["pagerank"] for r in got.values()) == pytest.approx(1, abs=1e-6)
    two = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    two = spark.createDataFrame([(*x, 1.0) for x in two], "src string, dst string, weight double")
    for how in graph.COMMUNITIES:
        groups = {}
        for r in graph.communities(two, how).collect():
            groups.setdefault(r["cluster"], set()).add(r["node"])
        assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["d", "e", "f"]], how
    assert graph.centralities(path.limit(0)).count() == 0


def test_enrichment(spark):
    works = spark.createDataFrame([(0, "T0", None, "10.1/a", None), (1, "t1  x", "X", None, 5.0), (2, "T2", None, "10.9/z", None)], "work_id long, title string, author string, doi string, cites double")
    snap = spark.createDataFrame([("https://doi.org/10.1/a", "T0", 2020, 7, [(("Ann",),), (("Bo",),)], (("Press",),), ["https://openalex.org/W1"]), ("doi:10.1/b", "T1 x", None, 9, [], None, None)], "doi string, title string, publication_year int, cited_by_count long, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<host_organization_name:string>>, referenced_works array<string>")
    filled = enrichment.fill_missing_doi(works, snap)
    assert [r["doi"] for r in filled.orderBy("work_id").collect()] == ["10.1/a", "10.1/b", "10.9/z"]
    out = enrichment.enrich(filled, snap, ("author", "cites")).orderBy("work_id").collect()
    assert [(r["author"], r["cites"], r["missed"]) for r in out] == [("Ann, Bo", 7.0, []), ("X", 5.0, []), (None, None, ["author", "cites"])]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Authors;article  TITLE;Citation Count;Journal;Publisher;my_Field\nDoé;T;3;;P;z\n".encode("latin-1"))
    df = readers.read_works(spark, f"{tmp_path}/a.csv")
    r = df.first()
    assert (r["Author"], r["Title"], r["Times Cited"], r["Publisher"], r["My_Field"]) == ("Doé", "T", 3.0, "P", "z")
    (tmp_path / "a.ris").write_text("TY  - JOUR\nT1  - One\nAU  - Doe, J\nAU  - Roe, R\nPY  - 2020\nKW  - a\nKW  - b\nER  - \n\nTY  - JOUR\nTI  - Two\n")
    got = readers.read_works(spark, f"{tmp_path}/a.ris").orderBy("row_id").collect()
    assert [(r["Title"], r["Author"], r["Publication Year"]) for r in got] == [("One", "Doe, J, Roe, R", 2020.0), ("Two", None, None)]
    (tmp_path / "a.bib").write_text('@article{k, title={A {Nested} title}, author={A B and C D}, year=2020, journal="Jour", doi={10.1/x}}')
    r = readers.read_works(spark, f"{tmp_path}/a.bib").first()
    assert (r["Title"], r["Author"], r["Publication Year"], r["Publisher"], r["DOI"]) == ("A Nested title", "A B, C D", 2020.0, "Jour", "10.1/x")
    writers.write_text(writers.to_ris(readers.read_works(spark, f"{tmp_path}/a.bib")), f"{tmp_path}/out")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/out").collect())
    assert readers.parse_ris(text)[0]["Title"] == "A Nested title"
    bib = writers.to_bib(readers.read_works(spark, f"{tmp_path}/a.bib")).first()["value"]
    assert readers.parse_bib(bib.encode())[0]["Author"] == "A B, C D"
    (tmp_path / "a.xlsx").write_bytes(writers.xlsx_bytes(spark.createDataFrame([("X", 2020.0), (None, 1.0)], "Title string, Year double")))
    got = readers.read_works(spark, f"{tmp_path}/a.xlsx").orderBy("row_id").collect()
    assert [(r["Title"], r["Publication Year"]) for r in got] == [("X", 2020.0), (None, 1.0)]
    with pytest.raises(ValueError, match="Unsupported"):
        readers.read_works(spark, "x.doc")


def test_csv_block():
    assert extraction.csv_block("Here it is\nmodel,used,quote\na,yes,q\nb,no,r\nx,y\n") == "model,used,quote\na,yes,q\nb,no,r"
    assert extraction.csv_block("model,used\n") is None and extraction.csv_block(None) is None


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,Citations,Abstract Note,Journal Name\nT,7,words,J\n")
    r = readers.read_works(spark, f"{tmp_path}/a.csv").first()
    assert (r["Times Cited"], r["Abstract"], r["Publisher"], r["Author"]) == (7.0, "words", "J", None)


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,Note\nCaf\u00e9 \ufffd,x\n", "utf-8")
    assert readers.read_works(spark, f"{tmp_path}/a.csv").first()["Title"] == "Caf\u00e9 \ufffd"
    (tmp_path / "b.csv").write_bytes('Title|Note\n"Caf\u00e9\nbar"|x\n'.encode("latin-1"))
    assert readers.read_works(spark, f"{tmp_path}/b.csv").first()["Title"] == "Caf\u00e9\nbar"


def test_ris_records(spark, tmp_path):
    many = "".join(f"TY  - JOUR\nT1  - One {i}\nAB  - the NUMBER  - of {i}\nER  - \n\n" for i in range(500))
    (tmp_path / "a.ris").write_text(many)
    got = readers.read_works(spark, f"{tmp_path}/a.ris").orderBy("row_id").collect()
    assert [(r["Title"], r["Abstract"]) for r in got] == [(f"One {i}", f"the NUMBER  - of {i}") for i in range(500)]


def test_workbook_order_and_odd_numbers(spark):
    import io
    import zipfile

    book = writers.xlsx_bytes(spark.createDataFrame([("X", float("nan")), ("Y", float("inf"))], "Title string, n double"))
    assert readers.parse_xlsx(book) == [["Title", "n"], ["X"], ["Y", "inf"]]
    # the workbook names the second file first
    old = {n: zipfile.ZipFile(io.BytesIO(book)).read(n).decode() for n in zipfile.ZipFile(io.BytesIO(book)).namelist()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in old.items():
            if n == "xl/_rels/workbook.xml.rels":
                x = x.replace("worksheets/sheet1.xml", "worksheets/sheet2.xml")
            z.writestr(n, x)
        z.writestr("xl/worksheets/sheet2.xml", old["xl/worksheets/sheet1.xml"].replace("Title", "Second"))
    assert readers.parse_xlsx(out.getvalue())[0] == ["Second", "n"]


def test_workbook_over_a_sheet(spark, tmp_path):
    rows = [(i, f"t{i}", float("nan") if i % 3 else i / 2) for i in range(11)]
    df = spark.createDataFrame(rows, "n long, Title string, x double").coalesce(2)
    want = [["n", "Title", "x"], *([str(i), f"t{i}"] + ([] if i % 3 else [str(x)]) for i, _, x in rows)]
    assert readers.parse_xlsx(writers.xlsx_bytes(df, most_rows=4)) == want
    writers.write_xlsx(df, f"{tmp_path}/a.xlsx", most_bytes=200)
    got = readers.read_works(spark, f"{tmp_path}/a.xlsx").orderBy("row_id").collect()
    assert [(r["N"], r["Title"], r["X"]) for r in got] == [(str(i), t, None if i % 3 else str(x)) for i, t, x in rows]
    writers.write_xlsx(df.limit(0), f"{tmp_path}/b.xlsx")
    assert readers.read_works(spark, f"{tmp_path}/b.xlsx").count() == 0


def test_workbook_in_pieces(spark, tmp_path, monkeypatch):
    """Prefixes, comments, character data, shared strings and UTF-16, cut anywhere; the driver never holds the sheet."""
    import io
    import tracemalloc
    import zipfile

    old = zipfile.ZipFile(io.BytesIO(writers.xlsx_bytes(spark.createDataFrame([("X",)], "a string"))))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    body = "".join(f'<p:row><p:c t="s"><p:v>{i % 2}</p:v></p:c><!-- </p:row> --><p:c r="C{i}" t="inlineStr"><p:is><p:t><![CDATA[</p:row>{i}]]>é</p:t></p:is></p:c></p:row><p:row/>' for i in range(40))
    want = [x for i in range(40) for x in (["ab"[i % 2], None, f"</p:row>{i}é"], [])]
    for code in ("utf-8", "utf-16"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in old.namelist():
                z.writestr(n, f'<?xml version="1.0" encoding="{code}"?><p:worksheet xmlns:p="{main}"><p:sheetData>{body}</p:sheetData></p:worksheet>'.encode(code) if "sheet1" in n else old.read(n))
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>a</t></si><si><t>b</t></si></sst>')
        for size in (7, 100, 1 << 20):
            monkeypatch.setattr(readers, "SHEET_BYTES", size, raising=False)
            assert readers.parse_xlsx(out.getvalue()) == want
        (tmp_path / "c.xlsx").write_bytes(out.getvalue())
        monkeypatch.setattr(readers, "SHEET_BYTES", 300)
        df = readers.read_xlsx(spark, f"{tmp_path}/c.xlsx")
        assert df.columns == ["a", "column_1", "</p:row>0é"]
        assert [[x for x in r] for r in df.collect()] == [[*r, None, None, None][:3] for r in want[1:]]
    monkeypatch.setattr(readers, "SHEET_BYTES", 1 << 16)
    (tmp_path / "d.xlsx").write_bytes(writers.xlsx_bytes(spark.range(60_000).selectExpr("id", "'text ' || id AS Title", "id / 7 AS x")))
    tracemalloc.start()
    try:
        df = readers.read_xlsx(spark, f"{tmp_path}/d.xlsx")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 << 20
    assert [(r["id"], r["Title"]) for r in df.collect()] == [(str(i), f"text {i}") for i in range(60_000)]


def test_weighted_paths(spark):
    import itertools
    import random

    random.seed(8)
    edges = [(f"n{a}", f"n{b}", float(random.randint(1, 4))) for a, b in itertools.combinations(range(8), 2) if random.random() < 0.45]
    w = {(a, b): x for s, d, x in edges for a, b in ((s, d), (d, s))}
    nodes = sorted({a for a, _ in w})

    def shortest(s, t):
        best, found = float("inf"), []

        def go(path, d):
            nonlocal best, found
            if d > best:
                return
            if path[-1] == t:
                if d < best:
                    best, found = d, []
                found.append(path)
                return
            for b in nodes:
                if (path[-1], b) in w and b not in path:
                    go([*path, b], d + w[path[-1], b])

        go([s], 0.0)
        return found

    want = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        found = shortest(s, t)
        for p in found:
            for v in p[1:-1]:
                want[v] += 1 / len(found)
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    n = len(nodes)
    for r in graph.centralities(df, ("betweenness",)).collect():
        assert r["betweenness"] == pytest.approx(2 * want[r["node"]] / ((n - 1) * (n - 2)))


def test_pagerank_large(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    got = {r["node"]: r["rank"] for r in graph.pagerank_large(df, tolerance=1e-10).collect()}
    assert got["b"] == pytest.approx(0.15 / 3 + 0.85 * (got["a"] + got["c"]), abs=1e-8) and got["b"] == pytest.approx(0.48649, abs=1e-5)
    same = {r["node"]: r["pagerank"] for r in graph.centralities(df, ("pagerank",)).collect()}
    assert {k: round(v, 6) for k, v in same.items()} == {r["node"]: round(r["rank"], 6) for r in graph.pagerank_large(df).collect()}


def test_bounded_graphs(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_EDGES", 2)
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 2.0)], "src string, dst string, weight double")
    with pytest.raises(ValueError, match="more than 2 edges"):
        graph.communities(df)


def test_hot_references(spark, monkeypatch):
    import random

    random.seed(5)
    works = spark.createDataFrame([(i, "; ".join(sorted({f"W{random.randint(0, 9)}" for _ in range(6)} | {"W hot"}))) for i in range(40)], "work_id long, refs string")
    pairs, coupled = rows(mapping.co_citation(works)), rows(mapping.coupling(works))
    monkeypatch.setattr(mapping, "BLOCK", 7)
    monkeypatch.setattr(mapping, "LONG_LIST", 3)
    assert rows(mapping.co_citation(works)) == pairs and rows(mapping.coupling(works)) == coupled
    assert len(coupled) == 40 * 39 // 2


def test_graph_page(spark):
    nodes = spark.createDataFrame([("a<", 20.0, "red"), ("b", 15.0, None)], "id string, size double, color string")
    edges = spark.createDataFrame([("a<", "b", 2.0)], "src string, dst string, weight double")
    page = writers.graph_html(nodes, edges)
    assert page.count("<circle ") == 2 and page.count("<line ") == 1 and 'r="10.0" fill="red"' in page and "a&lt;" in page


def test_article_lists(spark):
    found = spark.createDataFrame([("P", "bpmm", True), ("P", "BPMM", True), ("A", "Matrix", False), ("A", "Matrix", False), ("B", "cmmi", True)], "article string, model string, used boolean")
    assert [tuple(r) for r in qualitative.article_lists(found).collect()] == [("BPMM", "P", "BPMM", True), ("BPMM", "P", "bpmm", True), ("Matrix", "A", "Matrix", False)]


def test_oracles(spark):
    """Sources, sinks and graph queries against their DuckDB forms."""
    import duckdb
    from pathlib import Path

    from citeflow.plans import catalog, round_trips

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name in (*round_trips.QUERIES, "betweenness", "eigenvector", "pagerank_large", "comm_greedy", "comm_lpa", "comm_louvain", "cluster_rank", "article_lists", "model_alias"):
        got = catalog.QUERIES[name](spark, d)
        want = con.sql(catalog.ORACLES[name])
        order = sorted(got.columns)
        assert sorted(want.columns) == order, name
        flat = lambda rs, cols: sorted(repr([round(v, 8) if isinstance(v, float) else v for v in (r[cols.index(c)] for c in order)]) for r in rs)
        assert flat([tuple(r) for r in got.collect()], got.columns) == flat(want.fetchall(), want.columns), name


def test_louvain(spark):
    """A partition whose modularity no merging improves, as good as the planted one."""
    import random

    import numpy as np

    random.seed(2)
    edges = [(f"n{a:02d}", f"n{b:02d}", float(random.randint(1, 5))) for a in range(30) for b in range(a) if random.random() < (0.5 if a // 10 == b // 10 else 0.04)]
    got = {r["node"]: r["cluster"] for r in graph.communities(spark.createDataFrame(edges, "src string, dst string, weight double"), "louvain").collect()}
    names = sorted(got)
    w = np.zeros((len(names), len(names)))
    for s, d, x in edges:
        w[names.index(s), names.index(d)] = w[names.index(d), names.index(s)] = x
    of = np.array([got[x] for x in names])
    best = graph.modularity(w, of)
    assert best > 0.3
    groups = set(of.tolist())
    assert all(graph.modularity(w, np.where(of == a, b, of)) <= best + 1e-9 for a in groups for b in groups)
    assert best >= graph.modularity(w, np.arange(len(names)) // 10) - 1e-9
