"""DuckDB forms of the graph measures and communities.

Each continues a WITH RECURSIVE clause that ends in g(src, dst, weight): nodes
get numbers by name, edges both directions, and iterations are recursive
queries that carry their state from round to round."""

from __future__ import annotations

_NODES = """, nd AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT src AS node FROM g UNION SELECT dst FROM g)),
e AS MATERIALIZED (SELECT x.i AS a, y.i AS b, weight AS w FROM g JOIN nd x ON src = x.node JOIN nd y ON dst = y.node UNION ALL SELECT y.i, x.i, weight FROM g JOIN nd x ON src = x.node JOIN nd y ON dst = y.node),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nd)"""

_STABLE = """, moved AS (SELECT p.k, sum(abs(p.x - q.x)) AS d FROM r p JOIN r q ON p.i = q.i AND p.k = q.k + 1 GROUP BY p.k),
last AS (SELECT min(k) AS k FROM moved, n WHERE d < n * 1e-6)"""

PAGERANK = _NODES + """, total AS (SELECT a, sum(w) AS t FROM e GROUP BY a),
r AS (SELECT 0 AS k, i, 1 / n AS x FROM nd, n UNION ALL
  SELECT k + 1, e.b, 0.15 / any_value(n) + 0.85 * sum(r.x * w / t) FROM r JOIN e ON e.a = r.i JOIN total ON total.a = e.a, n WHERE k < 120 GROUP BY k, e.b)""" + _STABLE + """
SELECT node, round(x, 9) AS pagerank FROM r JOIN nd USING (i) WHERE k = (SELECT k FROM last)"""

EIGENVECTOR = _NODES + """, r AS (SELECT 0 AS k, i, 1 / n AS x FROM nd, n UNION ALL
  SELECT k + 1, i, x / sqrt(sum(x * x) OVER ()) FROM (
    SELECT k, i, sum(x) AS x FROM (SELECT k, i, x FROM r UNION ALL SELECT k, e.b, r.x * w FROM r JOIN e ON e.a = r.i) WHERE k < 1000 GROUP BY k, i))""" + _STABLE + """
SELECT node, CASE WHEN last.k IS NULL THEN 0 ELSE round(x, 9) END AS eigenvector FROM r JOIN nd USING (i), last WHERE r.k = coalesce(last.k, 0)"""

BETWEENNESS = _NODES + """, walk AS (SELECT 0 AS k, i AS s, i AS v, CAST(0 AS DOUBLE) AS d FROM nd UNION ALL
  SELECT k + 1, s, v, min(d) FROM (SELECT k, s, v, d FROM walk UNION ALL SELECT k, s, e.b, d + w FROM walk JOIN e ON e.a = v) WHERE k < (SELECT n FROM n) GROUP BY k, s, v),
far AS MATERIALIZED (SELECT s, v, d FROM walk WHERE k = (SELECT max(k) FROM walk)),
tight AS MATERIALIZED (SELECT x.s, e.a, e.b FROM far x JOIN e ON e.a = x.v JOIN far y ON y.s = x.s AND y.v = e.b WHERE x.d + w = y.d),
ways AS (SELECT 0 AS k, i AS s, i AS v, CAST(1 AS DOUBLE) AS c FROM nd UNION ALL
  SELECT k + 1, ways.s, b, sum(c) FROM ways JOIN tight ON tight.s = ways.s AND tight.a = ways.v GROUP BY k, ways.s, b),
paths AS MATERIALIZED (SELECT s, v, sum(c) AS c FROM ways GROUP BY s, v),
sh AS (SELECT x.v AS i, sum(p.c * q.c / o.c) AS share FROM far x JOIN far y ON y.s = x.v JOIN far z ON z.s = x.s AND z.v = y.v
  JOIN paths p ON p.s = x.s AND p.v = x.v JOIN paths q ON q.s = y.s AND q.v = y.v JOIN paths o ON o.s = z.s AND o.v = z.v
  WHERE x.s <> x.v AND y.v <> x.v AND x.s <> y.v AND x.d + y.d = z.d GROUP BY x.v)
SELECT node, round(coalesce(share, 0) / ((n - 1) * (n - 2)), 9) AS betweenness FROM nd LEFT JOIN sh USING (i), n"""

#: Clusters numbered from 1, larger first, then by smallest node.
_NUMBERED = """, clusters AS (SELECT node, dense_rank() OVER (ORDER BY size DESC, low) AS cluster FROM (SELECT node, count(*) OVER (PARTITION BY c) AS size, min(node) OVER (PARTITION BY c) AS low FROM ended JOIN nd USING (i)))"""

GREEDY = _NODES + """, m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM e),
st AS (SELECT 0 AS k, i, i AS c FROM nd UNION ALL
  SELECT k + 1, st.i, CASE WHEN st.c = best.cj THEN best.ci ELSE st.c END FROM st, (
    SELECT x.c AS ci, y.c AS cj FROM (SELECT p.c, q.c AS o, CAST(count(*) AS DOUBLE) AS l FROM e JOIN st p ON p.i = e.a JOIN st q ON q.i = e.b WHERE p.c < q.c GROUP BY 1, 2) l
    JOIN (SELECT c, CAST(count(*) AS DOUBLE) AS d FROM e JOIN st ON st.i = e.a GROUP BY c) x ON x.c = l.c JOIN (SELECT c, CAST(count(*) AS DOUBLE) AS d FROM e JOIN st ON st.i = e.a GROUP BY c) y ON y.c = l.o, m
    WHERE l.l / m - x.d * y.d / (m * m) > 1e-12 ORDER BY l.l / m - x.d * y.d / (m * m) DESC, ci, cj LIMIT 1) best),
ended AS (SELECT i, c FROM st WHERE k = (SELECT max(k) FROM st))""" + _NUMBERED

LPA = _NODES + """, st AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS still, i, i AS c FROM nd UNION ALL
  SELECT st.k + 1, CASE WHEN new.c = old.c THEN st.still + 1 ELSE 0 END, st.i, CASE WHEN st.i = new.i THEN new.c ELSE st.c END FROM st, (
    SELECT any_value(t.v) AS i, arg_max(t.label, t.votes * 1000000 + CASE WHEN t.label = t.own THEN 500000 ELSE t.label END) AS c FROM (
      SELECT u.i AS v, u.c AS own, o.c AS label, count(*) AS votes FROM st u JOIN e ON e.a = u.i JOIN st o ON o.i = e.b, n WHERE u.i = u.k % CAST(n AS BIGINT) GROUP BY 1, 2, 3) t) new
    JOIN st old ON old.i = new.i, n WHERE st.still < n),
ended AS (SELECT i, c FROM st WHERE k = (SELECT max(k) FROM st))""" + _NUMBERED

CLUSTERS = "\nSELECT node, CAST(cluster AS INTEGER) AS cluster FROM clusters"

#: One node of a level moves a round, v points at it; after a sweep without a
#: move the communities become the next level's nodes.
LOUVAIN = _NODES + """, dg AS MATERIALIZED (SELECT a AS i, sum(w) AS d FROM e GROUP BY a), m AS (SELECT sum(w) AS m FROM e),
st AS (SELECT 0 AS k, 0 AS v, false AS sweep, false AS level, i, i AS node_, i AS c FROM nd UNION ALL
  SELECT st.k + 1, CASE WHEN st.v < s.n THEN st.v + 1 ELSE 0 END,
    st.v < s.n AND (st.sweep OR mv.c IS NOT NULL), CASE WHEN st.v < s.n THEN st.level OR mv.c IS NOT NULL ELSE st.sweep AND st.level END, st.i,
    CASE WHEN st.v = s.n AND NOT st.sweep THEN dense_rank() OVER (ORDER BY st.c) - 1 ELSE st.node_ END,
    CASE WHEN st.v = s.n AND NOT st.sweep THEN dense_rank() OVER (ORDER BY st.c) - 1 WHEN st.node_ = st.v AND mv.c IS NOT NULL THEN mv.c ELSE st.c END
  FROM st CROSS JOIN (SELECT max(node_) + 1 AS n FROM st) s LEFT JOIN (
    SELECT c FROM (SELECT c, gain, row_number() OVER (ORDER BY gain DESC, c) AS r, max(CASE WHEN c = own THEN gain END) OVER () AS mine FROM (
      SELECT l.c, l.own, l.links - coalesce(t.total, 0) * o.d / m.m AS gain FROM (
        SELECT c, any_value(own) AS own, sum(w) AS links FROM (
          SELECT y.c, x.c AS own, e.w FROM st x JOIN e ON e.a = x.i JOIN st y ON y.i = e.b WHERE x.node_ = x.v AND y.node_ <> x.v
          UNION ALL SELECT x.c, x.c, 0 FROM st x WHERE x.node_ = x.v) GROUP BY c) l
      LEFT JOIN (SELECT z.c, sum(dg.d) AS total FROM st z JOIN dg ON dg.i = z.i WHERE z.node_ <> z.v GROUP BY z.c) t ON t.c = l.c
      CROSS JOIN (SELECT sum(dg.d) AS d FROM st z JOIN dg ON dg.i = z.i WHERE z.node_ = z.v) o CROSS JOIN m)) WHERE r = 1 AND gain > mine + 1e-12) mv ON true
  WHERE st.v < s.n OR st.sweep OR st.level),
ended AS (SELECT i, c FROM st WHERE k = (SELECT max(k) FROM st))""" + _NUMBERED
