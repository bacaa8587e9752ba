"""Sources and sinks as queries: tables written out and read back."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from citeflow.operators import enrichment, mapping, qualitative, trends
from citeflow.sources import extraction, readers, scratch, writers

from .adapters import MODELS, WORKS, markers, works



def _title(more: str = ""):
    """Beside plain titles some with quotes, separators and letters of Latin-1."""
    return F.when(F.col("work_id") % 5 == 0, F.concat("title", F.lit(' "café"; a, b|c' + more))).otherwise(F.col("title"))


_TITLE_SQL = "CASE WHEN work_id % 5 = 0 THEN title || ' \"café\"; a, b|c' ELSE title END"
_BROKEN_SQL = "CASE WHEN work_id % 5 = 0 THEN title || ' \"café\"; a, b|c' || chr(10) || 'end' ELSE title END"
_FIELDS = "author AS \"Author\", refs AS \"Article References\", cites AS \"Times Cited\", pub_year AS \"Publication Year\""


def _table(w, title):
    return w.select(F.col("work_id").alias("work   number"), title.alias(" Article  TITLE"), F.col("author").alias("Authors"), F.col("refs").alias("Cited References"), F.col("cites").alias("Citations"), F.col("pub_year").alias("Year"))


def _back(df):
    return df.select(F.col("Work Number").cast("long").alias("work_id"), "Title", "Author", "Article References", "Times Cited", "Publication Year")


def _csv(more: str, sep: str, encoding: str):
    def run(s, d):
        path = scratch.new_path(s) + ".csv"
        _table(works(s, d), _title(more)).write.csv(path, header=True, sep=sep, escape='"', encoding=encoding)
        return _back(readers.read_works(s, path))

    return run


def _xlsx(s, d):
    path = scratch.new_path(s) + ".xlsx"
    writers.write_xlsx(_table(works(s, d), _title()), path)
    return _back(readers.read_works(s, path))


def _export(w):
    return w.select(F.col("work_id").alias("row_id"), _title().alias("Title"), F.col("author").alias("Author"), F.col("pub_year").alias("Publication Year"), F.concat(F.lit("10.1/"), F.col("work_id").cast("string")).alias("DOI"), F.lit(None).cast("string").alias("Abstract"), F.lit("Press").alias("Publisher"))


def _records(kind: str, to):
    def run(s, d):
        path = f"{scratch.new_path(s)}.{kind}"
        writers.write_text(to(_export(works(s, d))), path)
        return readers.read_works(s, path).select("Title", "Author", "Publication Year", "DOI")

    return run


def _markers(s, d):
    path = scratch.new_path(s) + ".csv"
    markers(s, d).orderBy("row_id").select(F.col("status").alias(" Status"), F.col("data").alias("DATA")).coalesce(1).write.csv(path, header=True, escape='"')
    found = qualitative.models(readers.read_markers(s, path))
    return found.groupBy("article", "model", "used").agg(F.count(F.lit(1)).alias("n"))


def _sink_csv(s, d):
    path = scratch.new_path(s)
    writers.write_csv(works(s, d).select("work_id", _title().alias("title"), "cites"), path, single=True)
    return s.read.csv(path, header=True, escape='"', schema="work_id long, title string, cites double")


def _sink_excel(s, d):
    df = works(s, d).select("work_id", F.when(F.col("work_id") % 3 == 0, F.lit(float("nan"))).when(F.col("work_id") % 3 == 1, F.lit(float("inf"))).otherwise(F.col("cites")).alias("x"), F.col("author"))
    path = scratch.new_path(s) + ".xlsx"
    writers.write_xlsx(df, path)
    return readers.read_xlsx(s, path).select(F.col("work_id").cast("long").alias("work_id"), "x", "author")


def _dispatch(s, d):
    out = []
    for path in ("a/b.XLSX", "a.csv", "a.tar.ris", "a.bib", "a.xls", "a.txt", "none"):
        kind = path.rsplit(".", 1)[-1].lower()
        out.append((path, kind in readers.READERS))
    return s.createDataFrame(out, "path string, known boolean")


def _answer(text: str) -> str:
    """Stands in for a language model."""
    n = len(text)
    if n % 5 == 0:
        raise ValueError("no answer")
    return "nothing here" if n % 5 == 1 else f"Here it is:\nmodel,used\nM{n % 7},yes\n\nbye"


def _extracted(s, d):
    texts = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return extraction.extract(texts, _answer, most=2000)


def _appended(s, d):
    path, rows = scratch.new_path(s), scratch.written(_extracted(s, d))
    for part in (0, 1):
        writers.append_csv(rows.where(F.col("path").cast("long") % 2 == part).where("error is null").select("path", "line", "value"), path)
    return s.read.csv(path, escape='"', schema="path string, line int, value string")


def _pdf(s, d):
    folder = scratch.new_path(s)
    for r in s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name").collect():  # 25 rows
        scratch.put(s, r["n_name"].encode(), f"{r['n_nationkey']}.pdf", folder)
    scratch.put(s, b"other", "notes.txt", folder)

    def pages(content: bytes):
        if content.startswith(b"A"):
            raise ValueError("damaged")
        return [content.decode(), "|end"]

    found = readers.pdf_text(readers.read_pdf_bytes(s, folder), pages)
    return found.select(F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long").alias("n_nationkey"), "text")


def _cached(s, d):
    rows = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("fetched_at"))
    import datetime

    return enrichment.fresh(rows, datetime.date(1995, 6, 17)).select("o_orderkey")


def _page(s, d):
    edges = scratch.written(mapping.graph(mapping.co_citation(works(s, d))))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg((15 + F.count(F.lit(1))).alias("size")).orderBy("id")
    page = writers.graph_html(nodes, edges)
    data = json.loads(re.search(r"<script type='application/json'>(.*)</script>", page, re.S)[1].replace("<\\/", "</"))
    drawn = page.count("<line "), page.count("<circle ")
    return s.createDataFrame([(e["from"], e["to"], float(e["value"]), *drawn) for e in data["edges"]], "src string, dst string, weight double, n_lines int, n_circles int")


_CC = """, refs_ AS (SELECT DISTINCT work_id, trim(unnest(string_split(refs, ';'))) AS ref FROM works WHERE refs IS NOT NULL),
g AS MATERIALIZED (SELECT a.ref AS src, b.ref AS dst, CAST(count(*) AS DOUBLE) AS weight FROM refs_ a JOIN refs_ b ON a.work_id = b.work_id AND a.ref < b.ref WHERE a.ref <> '' AND b.ref <> '' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100)"""
_ANSWERS = """WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS path, length(coalesce(text, '')) AS n, strlen(coalesce(text, '')) // 4 >= 2000 AS long FROM documents),
x AS (SELECT path, 0 AS line, CAST(NULL AS VARCHAR) AS value, CASE WHEN long THEN 'too long' ELSE 'no answer' END AS error FROM t WHERE long OR n % 5 = 0
  UNION ALL SELECT path, 0, 'Not valid csv text, check the article', NULL FROM t WHERE NOT long AND n % 5 = 1
  UNION ALL SELECT path, 0, 'model,used', NULL FROM t WHERE NOT long AND n % 5 > 1
  UNION ALL SELECT path, 1, 'M' || n % 7 || ',yes', NULL FROM t WHERE NOT long AND n % 5 > 1)"""

QUERIES = {
    "src_csv": (_csv("\nend", ";", "UTF-8"), f"WITH {WORKS} SELECT work_id, {_BROKEN_SQL} AS \"Title\", {_FIELDS} FROM works"),
    "src_csv_latin1": (_csv("", "|", "ISO-8859-1"), f"WITH {WORKS} SELECT work_id, {_TITLE_SQL} AS \"Title\", {_FIELDS} FROM works"),
    "src_excel": (_xlsx, f"WITH {WORKS} SELECT work_id, {_TITLE_SQL} AS \"Title\", {_FIELDS} FROM works"),
    "src_ris": (_records("ris", writers.to_ris), f"WITH {WORKS} SELECT {_TITLE_SQL} AS \"Title\", author AS \"Author\", pub_year AS \"Publication Year\", '10.1/' || work_id AS \"DOI\" FROM works"),
    "src_bib": (_records("bib", writers.to_bib), f"WITH {WORKS} SELECT {_TITLE_SQL} AS \"Title\", coalesce(author, 'Unknown') AS \"Author\", pub_year AS \"Publication Year\", '10.1/' || work_id AS \"DOI\" FROM works"),
    "src_qual": (_markers, f"WITH {MODELS} SELECT article, model, used, count(*) AS n FROM models GROUP BY ALL"),
    "src_dispatch": (_dispatch, "SELECT * FROM (VALUES ('a/b.XLSX', true), ('a.csv', true), ('a.tar.ris', true), ('a.bib', true), ('a.xls', false), ('a.txt', false), ('none', false)) x(path, known)"),
    "src_http_cache": (_cached, "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-06-10'"),
    "src_pdf": (_pdf, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_name LIKE 'A%' THEN '' ELSE n_name || '|end' END AS text FROM nation"),
    "snk_csv": (_sink_csv, f"WITH {WORKS} SELECT work_id, {_TITLE_SQL} AS title, cites FROM works"),
    "snk_excel": (_sink_excel, f"WITH {WORKS} SELECT work_id, CASE work_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'inf' ELSE CAST(cites AS VARCHAR) END AS x, author FROM works"),
    "snk_html_graph": (_page, f"WITH {WORKS}{_CC} SELECT *, 100 AS n_lines, (SELECT CAST(count(*) AS INTEGER) FROM (SELECT src FROM g UNION SELECT dst FROM g)) AS n_circles FROM g"),
    "llm_extract": (_extracted, f"{_ANSWERS} SELECT * FROM x"),
    "snk_err": (lambda s, d: _extracted(s, d).where("error is not null").select("path", "error"), f"{_ANSWERS} SELECT path, error FROM x WHERE error IS NOT NULL"),
    "snk_llm_csv": (_appended, f"{_ANSWERS} SELECT path, line, value FROM x WHERE error IS NULL"),
    "req_cols": (lambda s, d: s.createDataFrame([(c,) for c in sorted(trends.missing_columns(works(s, d), {"title", "abstract", "doi"}))], "missing string"), "SELECT * FROM (VALUES ('abstract'), ('doi')) x(missing)"),
}
