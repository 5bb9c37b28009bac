"""Registered queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bramble.operators import charts, clean, density, exact, peel, stats, verify
from bramble.plans import api, tables
from bramble.sources import generators, graph
from bramble.sources.store import fresh_dir, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _values(rows, columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join(str(r) for r in rows)}) v({columns}))"


# --- SQL pieces -------------------------------------------------------------------------------------------------------
_SUPPLY = "e AS (SELECT DISTINCT 'supply' AS g, l_suppkey AS src, 1000000 + l_partkey AS dst FROM lineitem)"
_TRADE = """deliveries AS (SELECT c_nationkey, s_nationkey, count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey),
e AS (SELECT DISTINCT 'trade' AS g, CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS src, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS dst FROM deliveries
  WHERE c * (SELECT count(*) FROM deliveries) > (SELECT sum(c) FROM deliveries))"""
_REGION = "e AS (SELECT r_name AS g, CAST(n_nationkey AS BIGINT) AS src, CAST(100 + r_regionkey AS BIGINT) AS dst FROM nation JOIN region ON n_regionkey = r_regionkey)"
_LINKS = """h AS (SELECT DISTINCT 'p:' || page_id AS a, 'h:' || href AS b FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)),
l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS vid FROM (SELECT a AS label FROM h UNION SELECT b FROM h)),
e AS (SELECT DISTINCT 'links' AS g, least(x.vid, y.vid) AS src, greatest(x.vid, y.vid) AS dst FROM h JOIN l x ON x.label = a JOIN l y ON y.label = b)"""
_ENDS = "v AS (SELECT g, src AS vid FROM e UNION SELECT g, dst FROM e)"
_FIXTURE_E = "e AS " + _values([(k, a, b) for k, (_, _, pairs) in generators.FIXTURES.items() for a, b in {(min(p), max(p)) for p in pairs}], "g, src, dst")
_FIXTURE_V = "v AS " + _values([(k, v) for k, (_, n, _) in generators.FIXTURES.items() for v in range(n)], "g, vid")
_SYM = "s AS (SELECT g, src AS u, dst AS v FROM e UNION ALL SELECT g, dst, src FROM e)"
_PEEL = """w AS (SELECT g, u, v FROM s UNION ALL SELECT g, vid, NULL FROM v),
st AS (
  SELECT 0 AS step, g, u, v, first_value(u) OVER p AS vic, first_value(deg) OVER p AS vdeg
  FROM (SELECT g, u, v, count(v) OVER (PARTITION BY g, u) AS deg FROM w) WINDOW p AS (PARTITION BY g ORDER BY deg, u)
  UNION ALL
  SELECT step + 1, g, u, v, first_value(u) OVER p, first_value(deg) OVER p
  FROM (SELECT step, g, u, v, count(v) OVER (PARTITION BY g, u) AS deg FROM st WHERE u <> vic AND (v IS NULL OR v <> vic)) WINDOW p AS (PARTITION BY g ORDER BY deg, u)),
tr AS (SELECT g, CAST(step + 1 AS BIGINT) AS step, CAST(vic AS BIGINT) AS vid, count(DISTINCT u) AS n, CAST(count(v) / 2 AS BIGINT) AS m, max(vdeg) AS deg FROM st GROUP BY g, step, vic)"""
_DK = """dk AS (SELECT g, n - 1 AS k,
  CAST(max(ceil(2.0 * m / n)) OVER (PARTITION BY g ORDER BY n DESC) AS BIGINT) AS dk_density,
  coalesce(max(deg) OVER (PARTITION BY g ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dk_tail_degree,
  max(deg) OVER (PARTITION BY g ORDER BY n DESC) AS dk_degeneracy FROM tr)"""
_REMOVAL = """ar AS (SELECT g, n AS k, CAST(max(ceil(2.0 * m / n)) OVER (PARTITION BY g ORDER BY n DESC) AS BIGINT) AS alpha_removal, max(n) OVER (PARTITION BY g) AS top FROM tr),
al AS (SELECT g, k, alpha_removal FROM ar WHERE k < top UNION ALL SELECT g, 0, 0 FROM tr WHERE step = 1)"""
_EXACT = """rk AS (SELECT g, vid, row_number() OVER (PARTITION BY g ORDER BY vid) - 1 AS b FROM v),
sm AS (SELECT g, count(*) AS n FROM v GROUP BY g HAVING count(*) <= 15),
mk AS (SELECT e.g, (1::BIGINT << x.b::INT) | (1::BIGINT << y.b::INT) AS mk FROM e JOIN rk x ON x.g = e.g AND x.vid = src JOIN rk y ON y.g = e.g AND y.vid = dst),
sb AS (SELECT g, unnest(range(1, 1::BIGINT << n::INT)) AS s FROM sm),
ct AS (SELECT sb.g, s, CAST(bit_count(s) AS BIGINT) AS size, count(mk) AS m FROM sb LEFT JOIN mk ON mk.g = sb.g AND (mk & s) = mk GROUP BY sb.g, s),
bs AS (SELECT g, size, max(CAST(ceil(2.0 * m / size) AS BIGINT)) AS best FROM ct GROUP BY g, size),
ax AS (SELECT g, size - 1 AS k, max(best) OVER (PARTITION BY g ORDER BY size DESC) AS alpha_exact FROM bs)"""
_CHECK = """ck AS (SELECT dk.g, dk.k, CASE WHEN alpha_exact IS NOT NULL THEN dk_degeneracy END AS dk, alpha_exact AS alpha_k, dk_degeneracy <= alpha_exact AS lower_bound_ok,
  alpha_exact <= 2 * dk_degeneracy AS upper_bound_ok,
  CASE WHEN alpha_exact IS NULL THEN NULL WHEN dk_degeneracy > 0 THEN alpha_exact / dk_degeneracy::DOUBLE ELSE 'inf'::DOUBLE END AS ratio
  FROM dk LEFT JOIN ax ON ax.g = dk.g AND ax.k = dk.k)"""
_TRADE_PEEL = f"WITH RECURSIVE {_TRADE}, {_ENDS}, {_SYM}, {_PEEL}"
_REGION_ALL = f"WITH RECURSIVE {_REGION}, {_ENDS}, {_SYM}, {_PEEL}, {_DK}, {_REMOVAL}, {_EXACT}, {_CHECK}"
_FIXTURE_PEEL = f"WITH RECURSIVE {_FIXTURE_E}, {_FIXTURE_V}, {_SYM}, {_PEEL}"
_FIXTURE_ALL = f"{_FIXTURE_PEEL}, {_DK}, {_REMOVAL}, {_EXACT}, {_CHECK}"
_REACH = "r(u, c) AS (SELECT vid, vid FROM v UNION SELECT s.v, r.c FROM r JOIN s ON s.u = r.u), co AS (SELECT u AS vid, min(c) AS component FROM r GROUP BY u)"


# --- sources and cleaning ---------------------------------------------------------------------------------------------
LINES = (
    "# FromNodeId\tToNodeId", "1 2", " 3\t4 99", "bad x", "5", "", "7 7", "2 1", "+8 9", "   # indented comment", "1_1 12", "1__3 2", "99999999999999999999 1",
)
_LINE_ROWS = ", ".join("('" + x.replace("\t", "' || chr(9) || '") + "')" for x in LINES)
_PARSE_SQL = f"""WITH t AS (SELECT regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS line FROM (VALUES {_LINE_ROWS}) v(value)),
p AS (SELECT line, regexp_split_to_array(line, '\\s+') AS a FROM t),
n AS (SELECT line, a, CASE WHEN regexp_full_match(a[1], '[+-]?[0-9]+(_[0-9]+)*') THEN TRY_CAST(replace(a[1], '_', '') AS BIGINT) END AS x,
  CASE WHEN regexp_full_match(a[2], '[+-]?[0-9]+(_[0-9]+)*') THEN TRY_CAST(replace(a[2], '_', '') AS BIGINT) END AS y FROM p),
k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN line LIKE '#%' THEN 'comment' WHEN len(a) < 2 THEN 'short' WHEN x IS NULL OR y IS NULL THEN 'bad' ELSE 'edge' END AS kind FROM n)"""


def _lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in LINES], "value string")


@_query(_PARSE_SQL + " SELECT DISTINCT least(x, y) AS src, greatest(x, y) AS dst FROM k WHERE kind = 'edge'")
def edge_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.parse_edge_list(_lines(spark)).edges.select("src", "dst")


@_query(_PARSE_SQL + " SELECT kind, count(*) AS n FROM k GROUP BY kind")
def edge_list_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.classify_lines(_lines(spark)).groupBy("kind").agg(F.count("*").alias("n"))


@_query(_PARSE_SQL + """, e AS (SELECT DISTINCT least(x, y) AS src, greatest(x, y) AS dst FROM k WHERE kind = 'edge'), v AS (SELECT src AS vid FROM e UNION SELECT dst FROM e)
SELECT (SELECT count(*) FROM v) AS n, count(*) AS m, (SELECT count(*) FROM e WHERE src = dst) AS self_loops,
  (SELECT count(*) FROM v WHERE vid NOT IN (SELECT src FROM e WHERE src <> dst UNION SELECT dst FROM e WHERE src <> dst)) AS isolated FROM e WHERE src <> dst""")
def self_loop_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = graph.parse_edge_list(_lines(spark))
    g = clean.remove_self_loops(raw)
    isolated = stats.degrees(g).groupBy("graph_id").agg(F.count_if(F.col("degree") == 0).alias("isolated"))
    return stats.size(g).join(clean.count_self_loops(raw), "graph_id").join(isolated, "graph_id").select("n", "m", "self_loops", "isolated")


@_query(f"WITH {_TRADE} SELECT src, dst FROM e WHERE src < 12 AND dst < 12")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.trade(spark, sf_dir)
    return clean.induced_subgraph(g, g.vertices.filter("vid < 12")).edges.select("src", "dst")


@_query(f"WITH {_TRADE} SELECT src, dst FROM e WHERE src <> 3 AND dst <> 3")
def remove_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.remove_vertex(tables.trade(spark, sf_dir), 3).edges.select("src", "dst")


@_query(f"WITH RECURSIVE {_LINKS}, {_ENDS}, {_SYM}, {_REACH} SELECT vid, component FROM co")
def components_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.components(tables.links(spark, sf_dir)).select("vid", "component")


@_query(f"WITH RECURSIVE {_LINKS}, {_ENDS}, {_SYM}, {_REACH}, t AS (SELECT component FROM co GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT vid, label FROM co JOIN t USING (component) JOIN l USING (vid)")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.largest_component(tables.links(spark, sf_dir)).vertices.select("vid", "label")


#: Sums of the published list, written out and not made from graph.CATALOG: category, datasets, n, m.
_CATALOG_SUMS = (
    ("Collaboration Networks", 5, 69032, 450622), ("Social Networks", 6, 428366, 17892605), ("Communication Networks", 3, 309021, 707565),
    ("P2P Networks", 3, 25291, 86784), ("Product Networks", 4, 1476468, 11179529),
)


@_query("SELECT * FROM " + _values(_CATALOG_SUMS, "category, datasets, n, m"))
def catalog_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.catalog(spark).groupBy("category").agg(F.count("*").cast("int").alias("datasets"), F.sum("n").cast("int").alias("n"), F.sum("m").cast("int").alias("m"))


#: Sizes by the formulas of the families, and of the others by their definitions.
_SIZES_SQL = """WITH k AS (SELECT unnest(['K4', 'K5', 'K6', 'K10', 'C5', 'C6', 'C7', 'C8', 'C15', 'P5', 'P6', 'P7', 'P10', 'star5', 'star8']) AS graph_id),
x AS (SELECT graph_id, regexp_extract(graph_id, '^[A-Za-z]+') AS f, CAST(regexp_extract(graph_id, '[0-9]+$') AS INTEGER) AS i FROM k)
SELECT graph_id, CASE f WHEN 'star' THEN i + 1 ELSE i END AS n, CASE f WHEN 'K' THEN i * (i - 1) // 2 WHEN 'P' THEN i - 1 ELSE i END AS m FROM x
UNION ALL SELECT * FROM (VALUES ('petersen', 10, 15), ('circulant6', 6, 12), ('cubical', 8, 12), ('dodecahedral', 20, 30), ('grid3x3', 9, 12), ('C8_chords', 8, 10), ('C6_chords', 6, 8),
  ('two_edges', 4, 2), ('single', 1, 0), ('lollipop', 10, 15), ('two_dense', 11, 19), ('k4_isolated', 7, 6), ('bound_break', 7, 12), ('tie_a', 7, 8), ('tie_b', 7, 8), ('atie_a', 9, 7), ('atie_b', 9, 7)) v(graph_id, n, m)"""


@_query(_SIZES_SQL)
def generators_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size(generators.fixture_graphs(spark)).select("graph_id", F.col("n").cast("int").alias("n"), F.col("m").cast("int").alias("m"))


# --- statistics -------------------------------------------------------------------------------------------------------
@_query(f"WITH {_SUPPLY}, {_ENDS} SELECT (SELECT count(*) FROM v) AS n, count(*) AS m, 2.0::DOUBLE * count(*) / (SELECT count(*) FROM v) AS avg_degree FROM e")
def graph_stats_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size(tables.supply(spark, sf_dir)).select("n", "m", "avg_degree")


@_query(f"WITH {_SUPPLY}, {_SYM} SELECT u AS vid, count(*) AS degree FROM s GROUP BY u")
def degree_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.degrees(tables.supply(spark, sf_dir)).select("vid", "degree")


@_query(f"WITH {_SUPPLY}, {_SYM} SELECT min(d) AS min_degree, count(*) AS n FROM (SELECT count(*) AS d FROM s GROUP BY u)")
def min_degree_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.min_degree(tables.supply(spark, sf_dir)).select("min_degree", "n")


@_query(f"WITH {_TRADE}, {_ENDS}, n AS (SELECT count(*) AS n FROM v) SELECT any_value(n) AS n, count(*) AS m, 2.0::DOUBLE * count(*) / (any_value(n) * (any_value(n) - 1)) AS density FROM e, n")
def density_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size(tables.trade(spark, sf_dir)).select("n", "m", "density")


@_query(f"""WITH {_TRADE}, {_ENDS}, {_SYM}, d AS (SELECT u, count(*) AS d FROM s GROUP BY u),
t AS (SELECT a.u, count(*) / 2 AS t FROM s a JOIN s b ON a.u = b.u AND a.v <> b.v JOIN s c ON c.u = a.v AND c.v = b.v GROUP BY a.u)
SELECT avg(CASE WHEN d >= 2 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END) AS avg_clustering FROM d LEFT JOIN t USING (u)""")
def clustering_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.clustering(tables.trade(spark, sf_dir)).select("avg_clustering")


# --- peel, d_k, alpha_k -----------------------------------------------------------------------------------------------
_TRACE_OUT = "SELECT g AS graph_id, step, vid, n AS vertices_before, m AS edges_before, deg AS deg_at_removal FROM tr"


@_query(f"{_TRADE_PEEL} {_TRACE_OUT}")
def peel_trace_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peel.peel_trace(tables.trade(spark, sf_dir))


@_query(f"{_FIXTURE_PEEL} {_TRACE_OUT}")
def peel_trace_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peel.peel_trace(generators.fixture_graphs(spark))


_DK_OUT = "SELECT g AS graph_id, k, dk_density, dk_tail_degree, dk_degeneracy FROM dk"


@_query(f"{_TRADE_PEEL}, {_DK} {_DK_OUT}")
def dk_all_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.dk_all(peel.peel_trace(tables.trade(spark, sf_dir)))


@_query(f"{_FIXTURE_PEEL}, {_DK} {_DK_OUT}")
def dk_all_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.dk_all(peel.peel_trace(generators.fixture_graphs(spark)))


@_query(f"{_TRADE_PEEL}, {_DK} {_DK_OUT} WHERE k = 7")
def dk_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.dk_at(peel.peel_trace(tables.trade(spark, sf_dir)), 7)


@_query()
def dk_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All d_k of the supplier-part graph; tested against core numbers and a plain peel, as the recursion in SQL is too slow."""
    return density.dk_all(peel.peel_trace(tables.supply(spark, sf_dir)))


@_query(f"{_TRADE_PEEL}, {_DK}, c AS (SELECT g, k, dk_degeneracy FROM dk) SELECT g AS graph_id, k, dk_degeneracy FROM c")
def core_numbers_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peel.dk_degeneracy_from_cores(peel.core_numbers(tables.trade(spark, sf_dir)))


@_query(f"{_TRADE_PEEL}, {_REMOVAL} SELECT g AS graph_id, k, alpha_removal FROM al")
def alpha_removal_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.alpha_removal(peel.peel_trace(tables.trade(spark, sf_dir)))


@_query(f"""{_TRADE_PEEL}, x AS (SELECT g, max(deg) AS dk FROM tr WHERE n > 5 GROUP BY g), f AS (SELECT g, dk, min(step) AS step FROM tr JOIN x USING (g) WHERE n > 5 AND deg = dk GROUP BY g, dk),
h AS (SELECT tr.g, vid FROM tr JOIN f ON f.g = tr.g AND tr.step >= f.step), hs AS (SELECT s.g, s.u FROM s JOIN h a ON a.g = s.g AND a.vid = s.u JOIN h b ON b.g = s.g AND b.vid = s.v),
hd AS (SELECT h.g, h.vid, count(hs.u) AS d FROM h LEFT JOIN hs ON hs.g = h.g AND hs.u = h.vid GROUP BY h.g, h.vid)
SELECT g AS graph_id, 5::BIGINT AS k, any_value(dk) AS dk, any_value(step) AS step, count(*) AS n_witness, CAST(sum(d) / 2 AS BIGINT) AS m_witness, min(d) AS min_degree, sum(d)::DOUBLE / count(*) AS avg_degree
FROM hd JOIN f USING (g) GROUP BY g""")
def witness_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.trade(spark, sf_dir)
    return density.witness_report(g, stored(peel.peel_trace(g), "trace"), 5)


@_query(f"""{_TRADE_PEEL}, c AS (SELECT g, step, CAST(ceil(2.0 * m / n) AS BIGINT) AS q FROM tr WHERE n >= 5), b AS (SELECT g, min(step) AS first_step FROM c WHERE q = (SELECT max(q) FROM c) GROUP BY g)
SELECT tr.g AS graph_id, first_step AS step, vid FROM tr JOIN b ON b.g = tr.g AND tr.step >= first_step""")
def removal_witness_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.removal_witness(peel.peel_trace(tables.trade(spark, sf_dir)), 5)


@_query(f"{_TRADE_PEEL} SELECT g AS graph_id, list(vid ORDER BY step) AS removal_order FROM tr WHERE n <= 6 GROUP BY g")
def tail_order_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.tail_order(peel.peel_trace(tables.trade(spark, sf_dir)), 6)


@_query(f"""{_TRADE_PEEL}, {_DK}, n AS (SELECT g, count(*) AS n FROM v GROUP BY g), m AS (SELECT g, count(*) AS m FROM e GROUP BY g)
SELECT g AS graph_id, n, m, 2.0::DOUBLE * m / (n * (n - 1)) AS density, dk_density AS d0, CAST(ceil(dk_density / 2.0) AS BIGINT) AS half_density_ceiling FROM n JOIN m USING (g) JOIN dk USING (g) WHERE k = 0""")
def analyze_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.trade(spark, sf_dir)
    return density.analyze(g, stored(peel.peel_trace(g), "trace"))


@_query(f"{_REGION_ALL} SELECT g AS graph_id, k, alpha_exact FROM ax")
def alpha_exact_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.alpha_exact(tables.region_star(spark, sf_dir))


# --- checks and summaries ---------------------------------------------------------------------------------------------
def _region(spark: SparkSession, sf_dir: str) -> api.Analysis:
    return api.analyze(tables.region_star(spark, sf_dir))


def _fixtures(spark: SparkSession) -> api.Analysis:
    return api.analyze(generators.fixture_graphs(spark))


_CHECK_OUT = "SELECT g AS graph_id, k, dk, alpha_k, lower_bound_ok, upper_bound_ok, ratio FROM ck"


@_query(f"{_REGION_ALL} {_CHECK_OUT}")
def verify_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _region(spark, sf_dir).checked


@_query(f"{_FIXTURE_ALL} {_CHECK_OUT}")
def verify_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixtures(spark).checked


@_query(f"""{_REGION_ALL} SELECT g AS graph_id, k, dk, alpha_k, 2 * dk AS two_dk, CASE WHEN ratio = 'inf'::DOUBLE THEN 'inf' ELSE printf('%.3f', ratio) END AS ratio,
CASE WHEN lower_bound_ok THEN '✓' ELSE '✗' END AS lower, CASE WHEN upper_bound_ok THEN '✓' ELSE '✗' END AS upper FROM ck""")
def result_table_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.result_table(_region(spark, sf_dir).checked)


def _finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite and undefined figures as NULL, so that they compare alike; n_infinite tells of them."""
    return df.withColumns({c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in columns})


@_query(f"""{_FIXTURE_ALL} SELECT g AS graph_id, CASE WHEN isfinite(min(ratio)) THEN min(ratio) END AS min_ratio, CASE WHEN isfinite(max(ratio)) THEN max(ratio) END AS max_ratio,
CASE WHEN isfinite(max(ratio)) THEN avg(ratio) END AS mean_ratio, CASE WHEN isfinite(quantile_cont(ratio, 0.5)) THEN quantile_cont(ratio, 0.5) END AS median_ratio, count_if(ratio = 'inf'::DOUBLE)::BIGINT AS n_infinite,
bool_and(lower_bound_ok) AS all_lower_ok, bool_and(upper_bound_ok) AS all_upper_ok, CASE max(ratio) WHEN 2 THEN 'worst case' WHEN 1 THEN 'optimal' ELSE 'neither' END AS class
FROM ck WHERE ratio IS NOT NULL GROUP BY g""")
def ratio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finite(verify.ratio_summary(_fixtures(spark).checked), ["min_ratio", "max_ratio", "mean_ratio", "median_ratio"])


@_query(f"""{_FIXTURE_ALL}, f AS (SELECT * FROM ck WHERE ratio < 'inf'::DOUBLE),
sh AS (SELECT g, CASE WHEN min(ratio) = max(ratio) THEN min(ratio) - 0.5 ELSE min(ratio) END AS lo, CASE WHEN min(ratio) = max(ratio) THEN max(ratio) + 0.5 ELSE max(ratio) END AS hi,
  least(10, count(DISTINCT ratio))::INT AS bins, avg(ratio) AS mean, quantile_cont(ratio, 0.5) AS median FROM f GROUP BY g),
pl AS (SELECT g, least(bins - 1, floor((ratio - lo) / ((hi - lo) / bins)))::INT AS bin, count(*) AS c FROM f JOIN sh USING (g) GROUP BY 1, 2),
ev AS (SELECT *, unnest(range(0, bins))::INT AS bin FROM sh)
SELECT ev.g AS graph_id, ev.bin, lo + ev.bin * ((hi - lo) / bins) AS bin_lo, lo + (ev.bin + 1) * ((hi - lo) / bins) AS bin_hi, coalesce(c, 0) AS count, mean, median
FROM ev LEFT JOIN pl ON pl.g = ev.g AND pl.bin = ev.bin""")
def ratio_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.ratio_histogram(_fixtures(spark).checked)


_FAMILY = _values([(k, generators.FIXTURES[k][0]) for k in generators.FIXTURES], "g, family")


@_query(f"{_FIXTURE_ALL} SELECT family, count(*) AS graphs, min(ratio) AS min_ratio, max(ratio) AS max_ratio, bool_and(lower_bound_ok AND upper_bound_ok) AS all_ok FROM ck JOIN {_FAMILY} USING (g) WHERE k = 0 GROUP BY family")
def graph_family_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = spark.createDataFrame([(k, generators.FIXTURES[k][0]) for k in generators.FIXTURES], "graph_id string, family string")
    at0 = _fixtures(spark).checked.filter("k = 0").join(families, "graph_id")
    return at0.groupBy("family").agg(F.count("*").alias("graphs"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"), F.every(F.col("lower_bound_ok") & F.col("upper_bound_ok")).alias("all_ok"))


@_query(f"{_TRADE_PEEL}, {_DK} SELECT g AS graph_id, min(dk_degeneracy) AS min_dk, max(dk_degeneracy) AS max_dk, arg_max(dk_degeneracy, k) AS final_dk FROM dk GROUP BY g")
def dk_summary_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.dk_summary(density.dk_all(peel.peel_trace(tables.trade(spark, sf_dir))))


@_query(f"{_FIXTURE_ALL} SELECT g AS graph_id, min(alpha_exact) AS min_alpha, max(alpha_exact) AS max_alpha, max(alpha_exact) - min(alpha_exact) AS delta, CASE WHEN min(alpha_exact) = max(alpha_exact) THEN 'CONSTANT' ELSE 'VARYING' END AS trend FROM ax GROUP BY g")
def alpha_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.alpha_summary(exact.alpha_exact(generators.fixture_graphs(spark)))


@_query(f"{_TRADE_PEEL}, {_DK} SELECT g AS graph_id, max(dk_degeneracy) AS alpha_lo, 2 * max(dk_degeneracy) AS alpha_hi FROM dk GROUP BY g")
def alpha_interval_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.alpha_interval(density.dk_all(peel.peel_trace(tables.trade(spark, sf_dir))))


@_query(f"{_FIXTURE_ALL} SELECT g AS graph_id, max(alpha_k) AS max_alpha, max(dk) AS max_dk, CASE WHEN max(alpha_k) IS NULL THEN NULL WHEN max(dk) > 0 THEN max(alpha_k) / max(dk)::DOUBLE ELSE 'inf'::DOUBLE END AS max_alpha_by_dk FROM ck GROUP BY g")
def max_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.max_ratio(_fixtures(spark).checked)


@_query(f"{_REGION_ALL} SELECT dk.g AS graph_id, dk.k, dk_tail_degree AS dk, coalesce(alpha_exact, dk_tail_degree) AS alpha FROM dk LEFT JOIN ax ON ax.g = dk.g AND ax.k = dk.k WHERE dk.k >= 1")
def alpha_series_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _region(spark, sf_dir)
    return verify.alpha_or_dk(found.dk, found.alpha)


@_query(f"""{_FIXTURE_ALL}, dd AS (SELECT g, min(dk_degeneracy) AS min_dk, max(dk_degeneracy) AS max_dk FROM dk GROUP BY g), rr AS (SELECT g, avg(ratio) AS mean_ratio, min(ratio) AS min_ratio, max(ratio) AS max_ratio FROM ck GROUP BY g)
SELECT g AS graph_id, min_dk, max_dk, CASE WHEN isfinite(max_ratio) THEN mean_ratio END AS mean_ratio, CASE WHEN isfinite(min_ratio) THEN min_ratio END AS min_ratio, CASE WHEN isfinite(max_ratio) THEN max_ratio END AS max_ratio
FROM dd LEFT JOIN rr USING (g)""")
def cross_graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finite(_fixtures(spark).across(), ["mean_ratio", "min_ratio", "max_ratio"])


@_query(f"{_TRADE_PEEL}, {_DK} SELECT k, dk_degeneracy FROM dk WHERE k <= 5 OR k % 10 = 0 OR k = (SELECT max(k) FROM dk)")
def shown_rows_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.shown(density.dk_all(peel.peel_trace(tables.trade(spark, sf_dir)))).select("k", "dk_degeneracy")


@_query(f"WITH {_TRADE}, {_ENDS} SELECT 'trade' AS graph_id, unnest(range(2, least(19, count(*)), 3)) AS k FROM v")
def k_range_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.k_range(tables.trade(spark, sf_dir).vertices, 2, 18, 3)


# --- chart data -------------------------------------------------------------------------------------------------------
@_query(f"{_TRADE_PEEL}, {_DK}, {_REMOVAL} SELECT dk.g AS graph_id, dk.k, dk_tail_degree AS dk, alpha_removal AS alpha, dk_tail_degree AS band_lo, 2 * dk_tail_degree AS band_hi FROM dk LEFT JOIN al ON al.g = dk.g AND al.k = dk.k")
def chart_alpha_dk(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = stored(peel.peel_trace(tables.trade(spark, sf_dir)), "trace")
    return charts.alpha_lines(density.dk_all(trace), density.alpha_removal(trace))


@_query(f"{_REGION_ALL} SELECT dk.g AS graph_id, dk.k, CASE WHEN dk_tail_degree > 0 THEN alpha_exact / dk_tail_degree::DOUBLE ELSE 0 END AS ratio, 1.0::DOUBLE AS line_lo, 2.0::DOUBLE AS line_hi FROM dk JOIN ax ON ax.g = dk.g AND ax.k = dk.k WHERE dk.k >= 1")
def chart_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _region(spark, sf_dir)
    return charts.quality_line(verify.alpha_or_dk(found.dk, found.alpha))


@_query(f"{_REGION_ALL} SELECT g AS graph_id, dk, alpha_k AS alpha, k FROM ck WHERE alpha_k IS NOT NULL")
def chart_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.scatter(_region(spark, sf_dir).checked)


@_query(f"{_TRADE_PEEL}, {_DK} SELECT g AS graph_id, k, dk_density AS dk, min(dk_density) OVER () AS min_dk, max(dk_density) OVER () AS max_dk, first_value(dk_density) OVER (ORDER BY k DESC) AS final_dk FROM dk")
def chart_dk_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.dk_panel(density.dk_all(peel.peel_trace(tables.trade(spark, sf_dir))))


@_query(f"""{_REGION_ALL} SELECT dk.g AS graph_id, dk.k, alpha_exact AS alpha, dk_degeneracy AS dk, printf('α=%d, d=%d', alpha_exact, dk_degeneracy) AS label, min(alpha_exact) OVER p AS min_alpha, max(alpha_exact) OVER p AS max_alpha,
max(alpha_exact) OVER p - min(alpha_exact) OVER p AS delta, CASE WHEN min(alpha_exact) OVER p = max(alpha_exact) OVER p THEN 'CONSTANT' ELSE 'VARYING' END AS trend
FROM dk JOIN ax ON ax.g = dk.g AND ax.k = dk.k WINDOW p AS (PARTITION BY dk.g)""")
def chart_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _region(spark, sf_dir)
    return charts.configured(found.dk, found.alpha)


@_query(f"""{_REGION_ALL} SELECT dk.g AS graph_id, dk.k, dk_degeneracy AS dk, alpha_exact AS alpha, dk_degeneracy AS band_lo, 2 * dk_degeneracy AS band_hi, max(dk_degeneracy) OVER p AS alpha_lo, 2 * max(dk_degeneracy) OVER p AS alpha_hi
FROM dk LEFT JOIN ax ON ax.g = dk.g AND ax.k = dk.k WINDOW p AS (PARTITION BY dk.g)""")
def chart_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _region(spark, sf_dir)
    return charts.correlation(found.dk, found.alpha)


# --- files, sources and generators as a user calls them ---------------------------------------------------------------
def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """The folder of a text file (value) that is written as <name>.txt.gz."""
    folder = fresh_dir(spark, "files")
    lines.write.option("compression", "gzip").text(f"{folder}/{name}.txt.gz")
    return folder


def _customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge list of customers and their nations (1,000,000 and more), with comments, loops, repeats and bad lines."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation = F.lit(1_000_000) + F.col("c_nationkey")
    kinds = [
        F.concat_ws("\t", "c_custkey", nation), F.when(F.col("c_custkey") % 3 == 0, F.concat_ws(" ", nation, "c_custkey", F.lit("7"))),
        F.when(F.col("c_custkey") % 5 == 0, F.concat_ws(" ", "c_custkey", "c_custkey")), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("# "), "c_name")), F.when(F.col("c_custkey") % 11 == 0, F.lit("one 2")),
    ]
    return c.select(F.explode(F.array(*kinds)).alias("value")).filter("value IS NOT NULL")


_CUSTOMERS = "e AS (SELECT DISTINCT CAST(c_custkey AS BIGINT) AS src, CAST(1000000 + c_nationkey AS BIGINT) AS dst FROM customer)"


@_query(f"""WITH {_CUSTOMERS}, t AS (SELECT dst FROM e GROUP BY dst ORDER BY count(*) DESC, min(src) LIMIT 1), b AS (SELECT src, dst FROM e JOIN t USING (dst))
SELECT 'ca-GrQc' AS graph_id, src AS vid, 1::BIGINT AS degree FROM b UNION ALL SELECT 'ca-GrQc', dst, count(*) FROM b GROUP BY dst""")
def named_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogued graph from its file: parsed, without loops, largest component."""
    folder = _written(spark, _customer_lines(spark, sf_dir), "ca-GrQc")
    return stats.degrees(api.load(spark, "catalog", name="ca-GrQc", cache_dir=folder))


@_query(f"""WITH {_CUSTOMERS}, a AS (SELECT src, dst FROM e UNION ALL SELECT DISTINCT CAST(c_custkey AS BIGINT), CAST(c_custkey AS BIGINT) FROM customer WHERE c_custkey % 5 = 0)
SELECT src, dst, src = dst AS is_loop FROM a""")
def plain_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file as it stands: loops stay."""
    folder = _written(spark, _customer_lines(spark, sf_dir), "customers")
    return api.load(spark, "file", path=f"{folder}/customers.txt.gz").edges.select("src", "dst", (F.col("src") == F.col("dst")).alias("is_loop"))


@_query("""WITH e AS (SELECT DISTINCT least(n_nationkey, 30 + n_regionkey) AS src, greatest(n_nationkey, 30 + n_regionkey) AS dst FROM nation), s AS (SELECT src AS v FROM e UNION ALL SELECT dst FROM e)
SELECT CAST(i AS BIGINT) AS vid, CAST(i AS VARCHAR) AS label, count(v) AS degree FROM (SELECT unnest(range(0, 40)) AS i) LEFT JOIN s ON v = i GROUP BY i""")
def edge_list_with_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of numbers with a given number of vertices: some are isolated. The 25 nations are a list of fixed length."""
    pairs = [(r["n_nationkey"], 30 + r["n_regionkey"]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]
    g = graph.from_edge_list(spark, pairs, n=40)
    return stats.degrees(g).join(g.vertices, ["graph_id", "vid"]).select("vid", "label", "degree")


@_query(f"""WITH {_TRADE}, m AS (SELECT g, src, dst FROM e UNION SELECT 'trade', CAST(n_nationkey AS BIGINT), 100::BIGINT FROM nation) SELECT src, dst FROM m""")
def added_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More edges, some of which are there, given either way round: all nations to a new vertex, and the graph's own reversed."""
    g = tables.trade(spark, sf_dir)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("trade").alias("graph_id"), F.lit(100).cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"))
    own = g.edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return g.add_edges(nations.union(own)).edges.select("src", "dst")


@_query("""SELECT name, coalesce(c, 'other') AS category, coalesce(d, name) AS description, nm AS catalog_n FROM (VALUES ('ca-GrQc'), ('wiki-Vote'), ('my-graph')) f(name)
LEFT JOIN (VALUES ('ca-GrQc', 'Collaboration Networks', 'General Relativity collaboration', 5242::BIGINT), ('wiki-Vote', 'Communication Networks', 'Wikipedia voting network', 7115::BIGINT)) k(kn, c, d, nm) ON kn = name""")
def described_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with what the catalog knows of them, and a fallback."""
    found = spark.createDataFrame([("ca-GrQc",), ("wiki-Vote",), ("my-graph",)], "name string")
    return graph.described(spark, found).select("name", "category", "description", "catalog_n")


@_query("SELECT v AS vid, least(v, 3)::BIGINT AS earlier FROM (SELECT unnest(range(4, 200)) AS v) UNION ALL SELECT unnest([1, 2, 3]), 1")
def preferential_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners with smaller numbers in a preferential graph of 200 vertices: 3 for each new vertex, the centre for the first ones."""
    g = api.load(spark, "synthetic", kind="preferential", n=200, m=3, seed=7)
    return g.edges.groupBy(F.col("dst").alias("vid")).agg(F.count("*").alias("earlier"))


@_query("SELECT 3000::BIGINT AS n, 0::BIGINT AS bad_edges, 0::BIGINT AS repeated, true AS m_as_expected, true AS spread_as_expected")
def random_graph_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random graph of 3,000 vertices: simple, and its edges and squared degrees within five deviations of what p = 0.01 gives."""
    n, p = 3000, 0.01
    g = api.load(spark, "synthetic", kind="random", n=n, p=p, seed=11)
    pairs, mean = n * (n - 1) / 2, (n - 1) * p
    deg = stats.degrees(g).agg(F.count("*").alias("n"), F.sum("degree").alias("d"), F.var_pop("degree").alias("v"))
    bad = g.edges.agg(F.count_if(F.expr(f"src < 0 OR src >= dst OR dst >= {n}")).alias("bad_edges"), (F.count("*") - F.countDistinct("src", "dst")).alias("repeated"))
    m_ok = F.abs(F.col("d") / 2 - pairs * p) < 5 * (pairs * p * (1 - p)) ** 0.5
    v_ok = F.abs(F.col("v") / (mean * (1 - p)) - 1) < 5 * (2 / n) ** 0.5
    return deg.join(bad).select("n", "bad_edges", "repeated", m_ok.alias("m_as_expected"), v_ok.alias("spread_as_expected"))


# --- statistics, reports and ranges as a user calls them --------------------------------------------------------------
_CLUSTER = """dg AS (SELECT v.g, v.vid, count(s.v) AS d FROM v LEFT JOIN s ON s.g = v.g AND s.u = v.vid GROUP BY v.g, v.vid),
tr3 AS (SELECT a.g, a.u, count(*) / 2 AS t FROM s a JOIN s b ON a.g = b.g AND a.u = b.u AND a.v <> b.v JOIN s c ON c.g = a.g AND c.u = a.v AND c.v = b.v GROUP BY a.g, a.u),
cl AS (SELECT dg.g, avg(CASE WHEN d >= 2 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END) AS avg_clustering FROM dg LEFT JOIN tr3 ON tr3.g = dg.g AND tr3.u = dg.vid GROUP BY dg.g)"""
_STATS_SQL = f"""r(g, u, c) AS (SELECT g, vid, vid FROM v UNION SELECT r.g, s.v, r.c FROM r JOIN s ON s.g = r.g AND s.u = r.u), co AS (SELECT g, u, min(c) AS c FROM r GROUP BY g, u),
cc AS (SELECT g, count(DISTINCT c) = 1 AS connected FROM co GROUP BY g), nn AS (SELECT g, count(*) AS n FROM v GROUP BY g), mm AS (SELECT g, count(*) AS m FROM e GROUP BY g), {_CLUSTER}
SELECT g AS graph_id, n, coalesce(m, 0) AS m, 2.0::DOUBLE * coalesce(m, 0) / n AS avg_degree, CASE WHEN n > 1 THEN 2.0::DOUBLE * coalesce(m, 0) / (n * (n - 1)) END AS density, connected, avg_clustering
FROM nn LEFT JOIN mm USING (g) JOIN cc USING (g) JOIN cl USING (g)"""


@_query(f"WITH RECURSIVE {_TRADE}, {_ENDS}, {_SYM}, {_STATS_SQL}")
def graph_stats_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of one graph: size, density, connected, clustering."""
    return stats.graph_stats(tables.trade(spark, sf_dir))


@_query(f"WITH RECURSIVE {_FIXTURE_E}, {_FIXTURE_V}, {_SYM}, {_STATS_SQL}")
def graph_stats_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.graph_stats(generators.fixture_graphs(spark))


@_query(f"""{_FIXTURE_ALL}, x AS (SELECT g, max(deg) AS dk FROM tr WHERE n > 2 GROUP BY g), f AS (SELECT tr.g, dk, min(step) AS step FROM tr JOIN x USING (g) WHERE n > 2 AND deg = dk GROUP BY tr.g, dk),
h AS (SELECT tr.g, vid FROM tr JOIN f ON f.g = tr.g AND tr.step >= f.step), hs AS (SELECT s.g, s.u FROM s JOIN h a ON a.g = s.g AND a.vid = s.u JOIN h b ON b.g = s.g AND b.vid = s.v),
hd AS (SELECT h.g, h.vid, count(hs.u) AS d FROM h LEFT JOIN hs ON hs.g = h.g AND hs.u = h.vid GROUP BY h.g, h.vid),
wr AS (SELECT hd.g, 2::BIGINT AS k, any_value(f.dk) AS dk, any_value(step) AS step, count(*) AS n_witness, CAST(sum(d) / 2 AS BIGINT) AS m_witness, min(d) AS min_degree FROM hd JOIN f ON f.g = hd.g GROUP BY hd.g),
nn AS (SELECT g, count(*) AS n FROM v GROUP BY g), mm AS (SELECT g, count(*) AS m FROM e GROUP BY g), ar2 AS (SELECT g, alpha_k, CASE WHEN isfinite(ratio) THEN ratio END AS ratio FROM ck WHERE k = 2)
SELECT nn.g AS graph_id, n, coalesce(m, 0) AS m, 2.0::DOUBLE * coalesce(m, 0) / n AS avg_degree, CASE WHEN n > 1 THEN 2.0::DOUBLE * coalesce(m, 0) / (n * (n - 1)) END AS density,
  k, dk, step, n_witness, m_witness, min_degree, alpha_k, ratio
FROM nn LEFT JOIN mm ON mm.g = nn.g LEFT JOIN wr ON wr.g = nn.g LEFT JOIN ar2 ON ar2.g = nn.g""")
def graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on each graph at k = 2: size, d_k, exact alpha, ratio, witness."""
    return _finite(api.report(generators.fixture_graphs(spark), 2), ["ratio"])


@_query(f"""{_FIXTURE_ALL}, al2 AS (SELECT g, s, size, CAST(ceil(2.0 * m / size) AS BIGINT) AS a FROM ct WHERE size > 2),
tp AS (SELECT al2.g, al2.s, al2.size, a FROM al2 JOIN (SELECT g, max(a) AS a FROM al2 GROUP BY g) USING (g, a)),
ls AS (SELECT tp.g, a, size, list(rk.vid ORDER BY rk.vid) AS vids FROM tp JOIN rk ON rk.g = tp.g AND (s >> rk.b::INT) & 1 = 1 GROUP BY tp.g, s, a, size)
SELECT g AS graph_id, a AS alpha_exact, vids FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY size, vids) AS o FROM ls) WHERE o = 1""")
def exact_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first densest subset of more than 2 vertices: smaller ones first, then in the order of combinations."""
    return exact.exact_witness(generators.fixture_graphs(spark), 2)


_OUTSIDE = (-3, 0, 24, 25, 1000)


@_query(f"""{_TRADE_PEEL}, q AS (SELECT unnest({list(_OUTSIDE)})::BIGINT AS k)
SELECT g AS graph_id, k, coalesce(max(CASE WHEN n > greatest(k, 0) THEN CAST(ceil(2.0 * m / n) AS BIGINT) END), 0) AS dk_density, coalesce(max(CASE WHEN n <= k THEN deg END), 0) AS dk_tail_degree,
  coalesce(max(CASE WHEN n > greatest(k, 0) THEN deg END), 0) AS dk_degeneracy FROM tr, q GROUP BY g, k""")
def dk_outside_the_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each variant below 0, at the ends and beyond the number of vertices."""
    trace = stored(peel.peel_trace(tables.trade(spark, sf_dir)), "trace")
    return reduce(DataFrame.union, [density.dk_at(trace, k) for k in _OUTSIDE])


@_query(f"""{_TRADE_PEEL}, {_DK} SELECT k, dk_degeneracy, 'fifths' AS rule FROM dk WHERE (k + 1) % 5 = 0
UNION ALL SELECT k, dk_degeneracy, 'tenths' FROM dk WHERE (k + 1) % 10 = 0 OR k = (SELECT max(k) FROM dk) UNION ALL SELECT k, dk_degeneracy, 'listed' FROM dk WHERE k IN (1, 5, 10, 15, 19)""")
def shown_rows_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other rules of shown rows, and an explicit list of k."""
    dk = stored(density.dk_all(peel.peel_trace(tables.trade(spark, sf_dir))), "dk")
    kinds = {"fifths": clean.shown(dk, "fifths"), "tenths": clean.shown(dk, "tenths"), "listed": clean.at_k(dk, [1, 5, 10, 15, 19])}
    return reduce(DataFrame.union, [rows.select("k", "dk_degeneracy", F.lit(rule).alias("rule")) for rule, rows in kinds.items()])


@_query(f"""{_FIXTURE_ALL}, f AS (SELECT * FROM ck WHERE ratio < 'inf'::DOUBLE), ls AS (SELECT dk.g, dk.k, dk_degeneracy AS d, alpha_exact AS a FROM dk LEFT JOIN ax ON ax.g = dk.g AND ax.k = dk.k)
SELECT g AS graph_id, 'lines' AS panel, count(*) AS points, CAST(sum(k) AS BIGINT) AS sum_k, CAST(sum(d) AS BIGINT) AS sum_lo, CAST(sum(2 * d) AS BIGINT) AS sum_hi FROM ls GROUP BY g
UNION ALL SELECT g, 'ratio', count(*), CAST(sum(k) AS BIGINT), coalesce(count_if(d > 0 AND a >= d), 0)::BIGINT, coalesce(count_if(d > 0 AND a <= 2 * d), 0)::BIGINT FROM ls GROUP BY g
UNION ALL SELECT g, 'scatter', count(*), CAST(sum(k) AS BIGINT), CAST(sum(dk) AS BIGINT), CAST(sum(alpha_k) AS BIGINT) FROM ck WHERE alpha_k IS NOT NULL GROUP BY g
UNION ALL SELECT g, 'histogram', least(10, count(DISTINCT ratio)), NULL, count(*), count(*) FROM f GROUP BY g""")
def four_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables behind the four-panel chart, summed up by graph and panel."""
    found = _fixtures(spark)
    p = charts.four_panels(found.dk, found.alpha, found.checked)
    n, k = F.count("*").alias("points"), F.sum("k").alias("sum_k")

    def panel(name: str, *sums) -> DataFrame:
        cols = [c.cast("long").alias(a) for c, a in zip(sums, ("sum_lo", "sum_hi"), strict=True)]
        return p[name].groupBy("graph_id").agg(n, k if name != "histogram" else F.lit(None).cast("long").alias("sum_k"), *cols).select("graph_id", F.lit(name).alias("panel"), "points", "sum_k", "sum_lo", "sum_hi")

    r = F.col("ratio")
    finite = r < float("inf")
    return reduce(DataFrame.union, [
        panel("lines", F.sum("band_lo"), F.sum("band_hi")), panel("ratio", F.count_if(finite & (r >= F.col("line_lo"))), F.count_if(finite & (r <= F.col("line_hi")))),
        panel("scatter", F.sum("dk"), F.sum("alpha")), panel("histogram", F.sum("count"), F.sum("count")),
    ])


@_query(f"""WITH {_SUPPLY}, {_ENDS}, n AS (SELECT count(*) AS n FROM v), m AS (SELECT count(*) AS m FROM e)
SELECT n, m, 0::BIGINT AS out_of_order, 0::BIGINT AS wrong_degree, m AS sum_of_degrees, 1::BIGINT AS last_vertices, 0::BIGINT AS wrong_counts FROM n, m""")
def peel_check_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any peel must keep to, checked on its trace by joins: each vertex goes once, with as many later neighbours as its degree says, when no later
    vertex has fewer left; the edges before are those of the later vertices."""
    g = tables.supply(spark, sf_dir)
    trace = stored(peel.peel_trace(g), "trace")
    at = trace.select("graph_id", "vid", "step")
    both = g.edges.join(at.select("graph_id", F.col("vid").alias("src"), F.col("step").alias("su")), ["graph_id", "src"]).join(at.select("graph_id", F.col("vid").alias("dst"), F.col("step").alias("sv")), ["graph_id", "dst"])
    # An edge counts for the end that goes first.
    left = both.filter("su <> sv").groupBy("graph_id", F.when(F.col("su") < F.col("sv"), F.col("src")).otherwise(F.col("dst")).alias("vid")).agg(F.count("*").alias("d"))
    # When vertex v goes at step s with degree d, each later u has at least d neighbours from step s on: its least slack is over the steps before its own.
    checked = trace.join(left, ["graph_id", "vid"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    by_step = Window.partitionBy("graph_id").orderBy("step")
    first = checked.withColumn("gone", F.coalesce(F.sum("d").over(by_step.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    m = g.edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    # A removal lowers the least degree by one at most.
    drop = first.withColumn("before", F.lag("deg_at_removal").over(by_step)).join(m, "graph_id")
    return drop.groupBy("graph_id").agg(
        F.countDistinct("vid").alias("n"), F.first("m").alias("m"), F.count_if(F.col("deg_at_removal") < F.col("before") - 1).alias("out_of_order"), F.count_if(F.col("d") != F.col("deg_at_removal")).alias("wrong_degree"),
        F.sum("deg_at_removal").alias("sum_of_degrees"), F.min("vertices_before").alias("last_vertices"), F.count_if(F.col("edges_before") != F.col("m") - F.col("gone")).alias("wrong_counts"),
    ).drop("graph_id")


@_query("""SELECT printf('%-20s', name) || ' n~' || lpad(format('{:,}', n), 7, ' ') || '  m~' || lpad(format('{:,}', m), 9, ' ') || '  ' || d AS line
FROM (VALUES ('ca-GrQc', 5242, 14496, 'General Relativity collaboration'), ('ego-Facebook', 4039, 88234, 'Facebook social circles'), ('wiki-Vote', 7115, 103689, 'Wikipedia voting network')) v(name, n, m, d)""")
def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries as lines of a listing, with grouped and padded numbers."""
    return graph.catalog_lines(graph.catalog(spark).filter(F.col("name").isin("ca-GrQc", "ego-Facebook", "wiki-Vote"))).select("line")


@_query(f"""{_REGION_ALL}, su AS (SELECT g, min(alpha_exact) AS lo, max(alpha_exact) AS hi FROM ax GROUP BY g)
SELECT g AS graph_id, lo AS min_alpha, hi AS max_alpha, hi - lo AS delta, CASE WHEN lo = hi THEN 'CONSTANT' ELSE 'VARYING' END AS trend, x, y, h AS align, w AS valign
FROM su, (VALUES (0.02::DOUBLE, 0.98::DOUBLE, 'left', 'top'), (0.98::DOUBLE, 0.02::DOUBLE, 'right', 'bottom')) p(x, y, h, w)""")
def chart_info_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box beside the configured chart, in two places."""
    summary = stored(verify.alpha_summary(exact.alpha_exact(tables.region_star(spark, sf_dir))), "summary")
    return charts.info_box(summary).union(charts.info_box(summary, "lower right"))
