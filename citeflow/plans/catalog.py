"""Registered queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeflow.functions import text as T
from citeflow.operators import enrichment, graph, impact, mapping, qualitative, trends
from citeflow.sources import scratch, writers

from . import graph_sql, round_trips
from .adapters import MODELS, NAMED, WORKS, markers, named_markers, works

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def _on_works(name, f, sql=None, ctes="") -> None:
    _add(name, lambda s, d: f(works(s, d)), sql and f"WITH {WORKS}{ctes} {sql}")


def _on_models(name, f, sql=None) -> None:
    _add(name, lambda s, d: f(qualitative.models(markers(s, d))), sql and f"WITH {MODELS} {sql}")


# authors
_AUTHORS = """, authors AS (SELECT work_id, trim(unnest(string_split(author, ','))) AS author, cites FROM works WHERE author IS NOT NULL),
ranked AS (SELECT author, CAST(coalesce(cites, 0) AS BIGINT) AS c, row_number() OVER w AS r,
  sum(CAST(coalesce(cites, 0) AS BIGINT)) OVER (PARTITION BY author ORDER BY CAST(coalesce(cites, 0) AS BIGINT) DESC ROWS UNBOUNDED PRECEDING) AS cum
  FROM authors WINDOW w AS (PARTITION BY author ORDER BY CAST(coalesce(cites, 0) AS BIGINT) DESC)),
m AS (SELECT author, count(*) AS n_articles, CAST(sum(c) AS BIGINT) AS total_citations,
  coalesce(max(CASE WHEN c >= r THEN r END), 0) AS h_index, coalesce(max(CASE WHEN cum >= r * r THEN r END), 0) AS g_index,
  CAST(sum(c) AS DOUBLE) / count(*) AS avg_citations FROM ranked GROUP BY author)"""
_on_works("explode_authors", lambda w: impact.explode_authors(w), "SELECT work_id, author, cites FROM authors", _AUTHORS)
_on_works("author_metrics", lambda w: impact.author_metrics(w), "SELECT * FROM m", _AUTHORS)
for _by, _col in impact.RANKINGS.items():
    _on_works(f"top10_{_by}", lambda w, b=_by: impact.top_authors(impact.author_metrics(w), b), f"SELECT author, {_col} FROM m ORDER BY {_col} DESC, author LIMIT 10", _AUTHORS)
_on_works("authors_over_100", lambda w: impact.authors_over(impact.author_metrics(w)), "SELECT * FROM m WHERE total_citations > 100", _AUTHORS)
_LORENZ = _AUTHORS + """, l AS (SELECT row_number() OVER w AS i, sum(total_citations) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, count(*) OVER () AS n, sum(total_citations) OVER () AS total FROM m WINDOW w AS (ORDER BY total_citations, author))"""
_on_works("lorenz", lambda w: impact.lorenz(impact.author_metrics(w)), "SELECT CAST(i AS DOUBLE) / n AS author_share, CAST(cum AS DOUBLE) / total AS citation_share FROM l", _LORENZ)
_on_works("gini", lambda w: impact.gini(impact.author_metrics(w)).select(F.round("gini", 9).alias("gini")), "SELECT round((max(n) + 1 - 2 * CAST(sum(cum) AS DOUBLE) / max(total)) / max(n), 9) AS gini FROM l", _LORENZ)

# header, years, missing data
_on_works("header_metrics", trends.header_metrics, "SELECT (SELECT count(DISTINCT author) FROM authors) AS unique_authors, CAST(sum(cites) AS BIGINT) AS total_citations, sum(cites) / count(cites) AS avg_citations FROM works", _AUTHORS)
_YEARS = ", y AS (SELECT *, CAST(pub_year AS INTEGER) AS year FROM works WHERE pub_year IS NOT NULL)"
_on_works("articles_per_year", trends.articles_per_year, "SELECT year, count(*) AS n_articles FROM y GROUP BY year", _YEARS)
_on_works("pubs_cites_by_year", trends.pubs_cites_by_year, "SELECT year, count(*) AS n_articles, coalesce(sum(cites), 0.0) AS citations FROM y GROUP BY year", _YEARS)
_on_works("avg_cites_by_year", trends.avg_cites_by_year, "SELECT year, coalesce(sum(cites), 0.0) / count(*) AS avg_citations FROM y GROUP BY year", _YEARS)
_on_works("uncited_by_year", trends.uncited_by_year, "SELECT year, count(*) AS n_uncited FROM y WHERE coalesce(cites, 0) = 0 GROUP BY year", _YEARS)
_on_works("most_cited", trends.most_cited, "SELECT title, pub_year, cites FROM works WHERE cites > 100")
_on_works("missing_citations", trends.missing_citations, "SELECT title, pub_year FROM works WHERE cites IS NULL")
_on_works("missing_summary", trends.missing_summary, "SELECT count(*) FILTER (cites IS NULL) AS n_missing, 100.0 * count(*) FILTER (cites IS NULL) / count(*) AS percent_missing FROM works")
_on_works("preview", trends.preview, "SELECT * FROM works ORDER BY work_id LIMIT 7")

# references and pairs
_REFS = """, refs_ AS (SELECT work_id, ref FROM (SELECT work_id, trim(unnest(string_split(refs, ';'))) AS ref FROM works WHERE refs IS NOT NULL)
  WHERE ref <> '' AND ((regexp_matches(ref, '\\p{L}') AND contains(ref, ' ')) OR starts_with(lower(ref), '10.') OR contains(lower(ref), 'doi.org') OR starts_with(lower(ref), 'w'))),
d AS (SELECT DISTINCT * FROM refs_)"""
_CC = _REFS + ", cc AS (SELECT a.ref AS ref1, b.ref AS ref2, count(*) AS n FROM d a JOIN d b ON a.work_id = b.work_id AND a.ref < b.ref GROUP BY 1, 2)"
_BC = _REFS + ", bc AS (SELECT a.work_id AS work1, b.work_id AS work2, count(*) AS shared FROM d a JOIN d b ON a.ref = b.ref AND a.work_id < b.work_id GROUP BY 1, 2)"
_on_works("clean_refs", mapping.clean_refs, "SELECT * FROM refs_", _REFS)
_on_works("ref_summary", mapping.ref_summary, "SELECT (SELECT count(*) FROM refs_) AS total_refs, count(refs) AS with_refs, count(*) - count(refs) AS without_refs, 100.0 * (count(*) - count(refs)) / count(*) AS percent_without FROM works", _REFS)
_on_works("co_citation", mapping.co_citation, "SELECT * FROM cc", _CC)
_on_works("coupling", mapping.coupling, "SELECT * FROM bc", _BC)
_on_works("top20_cocitation", lambda w: mapping.top_pairs(mapping.co_citation(w), 20), "SELECT * FROM cc ORDER BY n DESC, ref1, ref2 LIMIT 20", _CC)
_on_works("top20_coupling", lambda w: mapping.top_pairs(mapping.coupling(w), 20), "SELECT * FROM bc ORDER BY shared DESC, work1, work2 LIMIT 20", _BC)

# graphs
_GCC = _CC + ", g AS MATERIALIZED (SELECT ref1 AS src, ref2 AS dst, CAST(n AS DOUBLE) AS weight FROM cc ORDER BY n DESC, ref1, ref2 LIMIT 100)"
_GBC = _BC + ", g AS MATERIALIZED (SELECT CAST(work1 AS VARCHAR) AS src, CAST(work2 AS VARCHAR) AS dst, CAST(shared AS DOUBLE) AS weight FROM bc ORDER BY shared DESC, work1, work2 LIMIT 100)"
_cc = lambda w: mapping.graph(mapping.co_citation(w))
_on_works("graph_build_cc", _cc, "SELECT * FROM g", _GCC)
_on_works("graph_build_bc", lambda w: mapping.graph(mapping.coupling(w)), "SELECT * FROM g", _GBC)
_on_works("degree", lambda w: graph.degree(_cc(w)), "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY node", _GCC)
_on_works("closeness", lambda w: graph.centralities(_cc(w), ("closeness",)).withColumn("closeness", F.round("closeness", 9)))
ORACLES["closeness"] = "WITH RECURSIVE " + WORKS + _GCC + """, e AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g),
walk AS (SELECT DISTINCT a AS s, a AS node, 0 AS k FROM e UNION SELECT s, b, k + 1 FROM walk JOIN e ON node = a WHERE k < 40),
steps AS (SELECT s, node, min(k) AS k FROM walk GROUP BY 1, 2), size AS (SELECT count(DISTINCT a) AS n FROM e)
SELECT s AS node, round(CAST(count(*) - 1 AS DOUBLE) / sum(k) * (count(*) - 1) / (max(n) - 1), 9) AS closeness FROM steps, size GROUP BY s"""
for _m, _sql in (("betweenness", graph_sql.BETWEENNESS), ("eigenvector", graph_sql.EIGENVECTOR), ("pagerank", graph_sql.PAGERANK)):
    _on_works(_m, lambda w, m=_m: graph.centralities(_cc(w), (m,)).withColumn(m, F.round(m, 9)))
    ORACLES[_m] = "WITH RECURSIVE " + WORKS + _GCC + _sql
_on_works("pagerank_large", lambda w: graph.pagerank_large(_cc(w)).select("node", F.round("rank", 9).alias("pagerank")))
ORACLES["pagerank_large"] = ORACLES["pagerank"]
for _how, _name in (("greedy", "comm_greedy"), ("label_propagation", "comm_lpa"), ("louvain", "comm_louvain")):
    _on_works(_name, lambda w, h=_how: graph.communities(_cc(w), h))
_GREEDY = "WITH RECURSIVE " + WORKS + _GCC + graph_sql.GREEDY
ORACLES["comm_greedy"] = _GREEDY + graph_sql.CLUSTERS
ORACLES["comm_louvain"] = "WITH RECURSIVE " + WORKS + _GCC + graph_sql.LOUVAIN + graph_sql.CLUSTERS
ORACLES["comm_lpa"] = "WITH RECURSIVE " + WORKS + _GCC + graph_sql.LPA + graph_sql.CLUSTERS


def _nodes(w):
    edges = scratch.written(_cc(w))
    return graph.communities(edges).join(graph.centralities(edges, ("degree",)), "node")


_on_works("cluster_rank", lambda w: graph.legend(_nodes(w), "degree"))
ORACLES["cluster_rank"] = _GREEDY + """, dg AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY node)
SELECT cluster || '-' || row_number() OVER (PARTITION BY cluster ORDER BY d DESC, node) AS label, node, CAST(cluster AS INTEGER) AS cluster, CAST(d AS DOUBLE) AS value FROM clusters JOIN dg USING (node)"""
_on_works("node_style", lambda w: graph.styled(graph.degree(_cc(w)), "degree"), r"""SELECT node, 15 + 40 * CAST(degree AS DOUBLE) / max(degree) OVER () AS size,
  'rgb(255, ' || CAST(trunc(200 - 100 * (CAST(degree AS DOUBLE) / max(degree) OVER ())) AS INTEGER) || ', ' || CAST(trunc(100 * (1 - CAST(degree AS DOUBLE) / max(degree) OVER ())) AS INTEGER) || ')' AS color,
  printf('%s' || chr(10) || 'degree: %.4f', node, CAST(degree AS DOUBLE)) AS title
  FROM (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY node)""", _GCC)
_on_works("node_max", lambda w: graph.degree(_cc(w)).agg(F.coalesce(F.max("degree"), F.lit(1)).alias("most")), "SELECT coalesce(max(degree), 1) AS most FROM (SELECT count(*) AS degree FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY node)", _GCC)
_on_works("edge_filter", lambda w: (lambda e: graph.inside(e, graph.degree(e).where("degree > 1")))(scratch.written(_cc(w))), "SELECT src, dst, weight FROM g WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)", _GCC + ", k AS (SELECT node FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY node HAVING count(*) > 1)")
_on_works("cluster_select", lambda w: graph.of_cluster(graph.communities(_cc(w)), 1))
ORACLES["cluster_select"] = _GREEDY + graph_sql.CLUSTERS + " WHERE cluster = 1"


# co-words, over documents
def _documents(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source")


_STOP = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in mapping.STOPWORDS) + ")"
_COWORD = f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
c AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(t, '\\s+')) AS word FROM t WHERE contains(t, 'with'))
  WHERE regexp_full_match(word, '\\p{{L}}+') AND word <> 'with' AND word NOT IN {_STOP} GROUP BY word)"""
_add("coword_df", lambda s, d: mapping.coword(_documents(s, d), "with", ["text"]), f"{_COWORD} SELECT * FROM c")
_add("coword_topn", lambda s, d: mapping.coword_top(mapping.coword(_documents(s, d), "with", ["text"])), f"{_COWORD} SELECT * FROM c ORDER BY n DESC, word LIMIT 20")
_add("coword_graph", lambda s, d: mapping.coword_graph(mapping.coword_top(mapping.coword(_documents(s, d), "with", ["text"])), "with"), f"{_COWORD} SELECT 'with' AS src, word AS dst, n AS weight, 10 + n AS size FROM c ORDER BY n DESC, word LIMIT 20")
_add("field_summary", lambda s, d: mapping.field_summary(works(s, d), ["title", "author", "cites"]), f"WITH {WORKS} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS present, count(*) - count({f}) AS missing, 100.0 * (count(*) - count({f})) / count(*) AS percent_missing FROM works" for f in ("title", "author", "cites")))

# qualitative
_on_models("ffill_article", lambda m: m.groupBy("article", "model").agg(F.count(F.lit(1)).alias("n")), "SELECT article, model, count(*) AS n FROM models GROUP BY 1, 2")
_on_models("models", lambda m: m, "SELECT * FROM models")
_on_models("cited_models", lambda m: qualitative.counted(m, False), "SELECT model, count(*) AS n FROM models WHERE NOT used GROUP BY 1")
_on_models("used_models", lambda m: qualitative.counted(m, True), "SELECT model, count(*) AS n FROM models WHERE used GROUP BY 1")
_SUMMARY = "SELECT model, count(*) FILTER (NOT used) AS citations, count(*) FILTER (used) AS uses FROM models GROUP BY 1"
_on_models("model_summary", qualitative.model_summary, _SUMMARY)
for _how, _test in (("only_used", "citations = 0"), ("only_cited", "uses = 0"), ("used_gt_cited", "uses > citations"), ("cited_gt_used", "citations > uses")):
    _on_models(_how, lambda m, h=_how: qualitative.compared(m, h), f"SELECT * FROM ({_SUMMARY}) WHERE {_test}")
_on_models("top_models_line", lambda m: qualitative.model_summary(m).where("citations >= 5"), f"SELECT * FROM ({_SUMMARY}) WHERE citations >= 5")
_on_models("recent_models", lambda m: qualitative.recent_models(m, 2024), "SELECT model, count(*) AS n FROM models WHERE NOT used AND year BETWEEN 2020 AND 2024 GROUP BY 1")
for _name, _used in (("yearly_cited", False), ("yearly_used", True)):
    _on_models(_name, lambda m, u=_used: qualitative.yearly(m, u), f"SELECT year, model, count(*) AS n FROM models WHERE used = {_used} AND year IS NOT NULL AND model IN (SELECT model FROM models WHERE used = {_used} AND year IS NOT NULL GROUP BY 1 HAVING count(*) > 10) GROUP BY 1, 2")
_on_models("yearly_total", qualitative.yearly_total, "SELECT year, model, n FROM (SELECT *, max(k) OVER () AS most FROM (SELECT *, sum(n) OVER (PARTITION BY model) AS k FROM (SELECT year, model, count(*) AS n FROM models WHERE year IS NOT NULL GROUP BY 1, 2))) WHERE k > 20 OR most <= 20")
_add("article_lists", lambda s, d: qualitative.article_lists(qualitative.models(named_markers(s, d))), f"""WITH {NAMED} SELECT DISTINCT grp, article, model, used FROM models JOIN (VALUES
  ('BSC', 'balanced scorecard (bsc)'), ('Performance Pyramid', 'smart system / performance pyramid'), ('Frameworks', 'framework'), ('BPMM', 'bpmm'), ('SCOR', 'scor'), ('Matrix', 'matrix')) x(grp, low) ON lower(model) = low""")
_add("model_alias", lambda s, d: qualitative.models(named_markers(s, d)).groupBy("model").agg(F.count(F.lit(1)).alias("n")), f"WITH {NAMED} SELECT model, count(*) AS n FROM models GROUP BY 1")
_on_models("yearly_pivot", lambda m: qualitative.pivoted(qualitative.yearly_total(m), ["M0", "M1", "none"]), "SELECT year, CAST(count(*) FILTER (model = 'M0') AS BIGINT) AS \"M0\", CAST(count(*) FILTER (model = 'M1') AS BIGINT) AS \"M1\", CAST(0 AS BIGINT) AS \"none\" FROM models WHERE year IS NOT NULL GROUP BY year")
_EMPTY = "SELECT event_id AS mark, data AS article FROM ev WHERE is_title AND event_id NOT IN (SELECT mark FROM models)"
_add("articles_without_models", lambda s, d: qualitative.articles_without_models(markers(s, d)), f"WITH {MODELS} {_EMPTY}")
_add("cited_bar", lambda s, d: (lambda m: qualitative.cited_bar(qualitative.models(m), m))(markers(s, d)), f"""WITH {MODELS}, n AS (SELECT model, count(*) AS n FROM models WHERE NOT used GROUP BY 1)
SELECT model, n FROM n WHERE n >= 5 UNION ALL SELECT * FROM (SELECT 'Other models' AS model, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM n WHERE n < 5) WHERE n > 0
UNION ALL SELECT * FROM (SELECT 'Articles without models' AS model, count(*) AS n FROM ({_EMPTY})) WHERE n > 0""")

# enrichment: every third work lacks its DOI, its year or its references
_GAPS = """, gaps AS (SELECT work_id, title, author, CASE WHEN work_id % 3 <> 0 THEN 'doi:10.1/' || work_id END AS doi, CASE WHEN work_id % 3 <> 1 THEN pub_year END AS pub_year, cites, CASE WHEN work_id % 3 <> 2 THEN refs END AS refs FROM works)"""


def _gaps(w):
    k = F.col("work_id")
    return w.select("work_id", "title", "author", F.when(k % 3 != 0, F.concat(F.lit("doi:10.1/"), k.cast("string"))).alias("doi"), F.when(k % 3 != 1, F.col("pub_year")).alias("pub_year"), "cites", F.when(k % 3 != 2, F.col("refs")).alias("refs"))


def _snapshot(w):
    """Nested records of the works whose id is even."""
    names = F.transform(F.split("author", ", "), lambda x: F.struct(F.struct(x.alias("display_name")).alias("author")))
    urls = F.transform(F.split("refs", "; "), lambda x: F.concat(F.lit("https://openalex.org/"), x))
    return w.where("work_id % 2 = 0").select(F.concat(F.lit("https://doi.org/10.1/"), F.col("work_id").cast("string")).alias("doi"), "title", F.col("pub_year").cast("int").alias("publication_year"), F.col("cites").cast("long").alias("cited_by_count"), names.alias("authorships"), F.struct(F.struct(F.lit("Press").alias("host_organization_name")).alias("source")).alias("primary_location"), urls.alias("referenced_works"))


_on_works("needs_enrichment", lambda w: _gaps(w).where(enrichment.needs_enrichment()).select("work_id"), "SELECT work_id FROM gaps WHERE doi IS NULL OR cites IS NULL OR refs IS NULL", _GAPS)
_on_works("fill_missing_doi", lambda w: enrichment.fill_missing_doi(_gaps(w), _snapshot(w)).select("work_id", "doi"), "SELECT work_id, coalesce(doi, CASE WHEN work_id % 2 = 0 THEN '10.1/' || work_id END) AS doi FROM gaps", _GAPS)
_on_works("enrich_join", lambda w: enrichment.enrich(_gaps(w), _snapshot(w), ("author", "pub_year", "cites", "refs")).select("work_id", "author", "pub_year", "cites", "refs", F.array_join("missed", ",").alias("missed")), """, f AS (SELECT g.work_id, g.author, CASE WHEN g.work_id % 3 = 1 AND g.work_id % 2 = 0 THEN w.pub_year ELSE g.pub_year END AS pub_year, g.cites, CASE WHEN g.work_id % 3 = 2 AND g.work_id % 2 = 0 THEN w.refs ELSE g.refs END AS refs FROM gaps g JOIN works w USING (work_id))
SELECT *, concat_ws(',', CASE WHEN author IS NULL THEN 'author' END, CASE WHEN pub_year IS NULL THEN 'pub_year' END, CASE WHEN cites IS NULL THEN 'cites' END, CASE WHEN refs IS NULL THEN 'refs' END) AS missed FROM f""".lstrip(), _GAPS)
ORACLES["enrich_join"] = f"WITH {WORKS}{_GAPS}" + ORACLES["enrich_join"].split(_GAPS, 1)[1].lstrip()
_on_works("snk_log", lambda w: enrichment.audit(enrichment.enrich(_gaps(w), _snapshot(w), ("pub_year",))).select("work_id", "doi"), "SELECT work_id, doi FROM gaps g WHERE pub_year IS NULL AND NOT (work_id % 3 = 1 AND work_id % 2 = 0 AND work_id % 17 <> 0)", _GAPS)


# scalars and exports
def _export(w):
    return w.select(F.col("work_id").alias("row_id"), F.col("title").alias("Title"), F.col("author").alias("Author"), F.col("pub_year").alias("Publication Year"), F.lit(None).cast("string").alias("DOI"), F.lit(None).cast("string").alias("Abstract"), F.lit("Press").alias("Publisher"))


_on_works("snk_ris", lambda w: writers.to_ris(_export(w)), """SELECT work_id AS row_id, 'TY  - JOUR' || chr(10) || 'T1  - ' || title || chr(10) || coalesce('AU  - ' || replace(author, ', ', chr(10) || 'AU  - ') || chr(10), '') || coalesce('PY  - ' || CAST(pub_year AS INTEGER) || chr(10), '') || 'ER  - ' || chr(10) AS value FROM works""")
_on_works("snk_bib", lambda w: writers.to_bib(_export(w)), """SELECT work_id AS row_id, '@article{ref' || work_id || ',' || chr(10) || '  author = {' || coalesce(replace(author, ', ', ' and '), 'Unknown') || '},' || chr(10) || '  title = {' || title || '},' || chr(10) || '  year = {' || coalesce(CAST(CAST(pub_year AS INTEGER) AS VARCHAR), 'Unknown') || '},' || chr(10) || '  journal = {Press}' || chr(10) || '}' || chr(10) AS value FROM works""")
# odd values of a column, and what becomes of each
_NUMBERS = (("1,000", "NULL"), (" 12 ", "12.0"), ("12d", "NULL"), ("1e3", "1000.0"), ("", "NULL"), ("nan", "NULL"), ("-.5", "-0.5"), ("+7.", "7.0"), ("1e-2x", "NULL"), ("\u00a02020.7\t", "2020.7"), ("Infinity", "NULL"))
_DOIS = ((" https://doi.org/10.1/a", "10.1/a"), ("doi:10.1/B c", "10.1/B c"), ("https://doi.org/doi:10.2/x\t", "10.2/x"), ("DOI:10.3/y", "DOI:10.3/y"), ("http://doi.org/10.4", "http://doi.org/10.4"), ("10.5/doi:z", "10.5/z"))
_YEARS_IN = (("Made in 1999 and 2004", "1999"), ("a12019b", "2019"), ("no 21st century", "NULL"), ("1850, 20013", "2001"), ("", "NULL"))


def _odd(values, f, name):
    return lambda w: w.select("work_id", f(F.get(F.array(*(F.lit(v) for v, _ in values)), (F.col("work_id") % len(values)).cast("int"))).alias(name))


def _odd_sql(values, name, quote=False):
    cells = ", ".join(f"'{v}'" if quote and v != "NULL" else v for _, v in values)
    return f"SELECT work_id, [{cells}][CAST(work_id % {len(values)} AS INTEGER) + 1] AS {name} FROM works"


_on_works("cast_numeric", _odd(_NUMBERS, T.number, "x"), _odd_sql(_NUMBERS, "x").replace("[NULL,", "[CAST(NULL AS DOUBLE),").replace("12.0,", "CAST(12 AS DOUBLE),"))
_on_works("extract_year", lambda w: _odd(_YEARS_IN, T.year_in, "year")(w).where("year is not null"), f"SELECT * FROM ({_odd_sql(_YEARS_IN, 'year')}) WHERE year IS NOT NULL")
_on_works("doi_norm", _odd(_DOIS, T.doi, "doi"), _odd_sql(_DOIS, "doi", quote=True))
_on_works("orange_color", lambda w: w.where("cites is not null").select("work_id", T.orange(F.col("cites"), F.lit(600.0)).alias("color")), "SELECT work_id, 'rgb(255, ' || CAST(trunc(200 - 100 * (cites / 600.0)) AS INTEGER) || ', ' || CAST(trunc(100 * (1 - cites / 600.0)) AS INTEGER) || ')' AS color FROM works WHERE cites IS NOT NULL")
_on_works("fmt_refs", lambda w: _snapshot(w).select("doi", T.work_ids(F.col("referenced_works")).alias("refs"), T.author_names(F.col("authorships")).alias("author")), "SELECT 'https://doi.org/10.1/' || work_id AS doi, refs, author FROM works WHERE work_id % 2 = 0")
_on_works("url_quote", lambda w: w.select("work_id", T.quoted(F.concat("title", F.lit(" ~*'é&/?="), F.coalesce("author", F.lit("-")))).alias("q")), "SELECT work_id, replace(url_encode(title || ' ~*''é&/?=' || coalesce(author, '-')), '%20', '+') AS q FROM works")

for _name, (_build, _sql) in round_trips.QUERIES.items():
    _add(_name, _build, _sql)
