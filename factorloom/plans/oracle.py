"""SQL that DuckDB checks the catalogue's queries with, by query name."""

from __future__ import annotations

from factorloom.functions import text as T
from factorloom.operators import context as C
from factorloom.operators import gates as G
from factorloom.operators import scoring as S

PANEL = """panel AS (SELECT o_orderkey AS episode, o_custkey AS symbol, c_mktsegment AS sector, o_orderdate AS earnings_date, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, o_totalprice AS move
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
FEATURES = """li AS (SELECT l_orderkey AS episode, count(*) AS n, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS d, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS q FROM lineitem GROUP BY 1),
features AS (SELECT 'discount' AS feature, episode, d / n AS value FROM li UNION ALL SELECT 'quantity', episode, q / n FROM li UNION ALL SELECT 'score', episode, CAST(least(greatest(floor(d / n) - 5, -2), 2) AS DOUBLE) FROM li)"""
ROWS = f"{PANEL}, {FEATURES}, rows_ AS (SELECT panel.*, feature, value FROM panel JOIN features USING (episode))"
TEST = "year IN (1999, 2000, 2001)"
IC = "covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def ic(source: str, by: str, y: str = "move", least: int = 5, where: str = "true") -> str:
    return f"SELECT * FROM (SELECT {by}, {IC.format(x='value', y=y)} AS ic, count(*) AS n FROM {source} WHERE value IS NOT NULL AND {y} IS NOT NULL AND {where} GROUP BY {by}) WHERE n >= {least} AND ic IS NOT NULL"


def newey_west(series: str) -> str:
    lags = ", ".join(f"e * lag(e, {k}) OVER (PARTITION BY feature ORDER BY year, quarter) AS p{k}" for k in range(1, 5))
    terms = " + ".join(f"2 * (1 - {k} / 5.0) * coalesce(sum(p{k}), 0) / count(*)" for k in range(1, 5))
    return f"""SELECT feature, avg(ic) AS ic_mean, CASE WHEN count(*) < 2 THEN 0 ELSE avg(ic) / sqrt(greatest(sum(e * e) / count(*) + {terms}, 1e-12) / count(*)) END AS t_stat, count(*) AS n_quarters
  FROM (SELECT feature, ic, e, {lags} FROM (SELECT *, ic - avg(ic) OVER (PARTITION BY feature) AS e FROM ({series}))) GROUP BY feature"""


NEUTRAL = "move - avg(move) OVER (PARTITION BY year, quarter, sector)"
TARGET = "(move - avg(move) OVER (PARTITION BY year, quarter)) / (stddev_samp(move) OVER (PARTITION BY year, quarter) + 1e-8)"
NAMES, WEIGHTS = ("discount", "quantity", "score"), (0.16, 0.07, 0.11)
Z = ", ".join(f"({n} - avg({n}) OVER w) / (stddev_samp({n}) OVER w + 1e-8) AS {n}_z" for n in NAMES)
WIDE = f"""{PANEL}, {FEATURES}, wide AS (SELECT panel.*, f.discount, f.quantity, f.score, {NEUTRAL} AS move_neutral, {TARGET} AS target FROM panel LEFT JOIN
  (SELECT episode, max(value) FILTER (feature = 'discount') AS discount, max(value) FILTER (feature = 'quantity') AS quantity, max(value) FILTER (feature = 'score') AS score FROM features GROUP BY episode) f USING (episode)),
z AS (SELECT *, {Z} FROM wide WINDOW w AS (PARTITION BY year, quarter)),
fused AS (SELECT *, ({' + '.join(f'coalesce({n}_z, 0)' for n in NAMES)}) / nullif({' + '.join(f'(CASE WHEN {n}_z IS NULL THEN 0 ELSE 1 END)' for n in NAMES)}, 0) AS fusion_equal,
  {' + '.join(f'coalesce({n}_z, 0) * {w / sum(WEIGHTS)!r}' for n, w in zip(NAMES, WEIGHTS))} AS fusion_icw, ({' OR '.join(f'coalesce({n}, 0) <> 0' for n in NAMES)}) AS text_covered FROM z),
scores AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, {n} AS value, episode, year, quarter, move_neutral, text_covered FROM fused" for n in (*NAMES, 'fusion_equal', 'fusion_icw'))})"""

SQL: dict[str, str] = {}
SQL["flagship_nw_ic"] = f"WITH {PANEL}, {FEATURES}, r AS (SELECT p.*, feature, value FROM (SELECT *, {NEUTRAL} AS mn FROM panel) p JOIN features USING (episode)) SELECT feature, round(ic_mean, 6) AS ic_mean, round(t_stat, 6) AS t_stat, n_quarters FROM ({newey_west(ic('r', 'feature, year, quarter', 'mn', where=TEST))})"
SQL["ic_series"] = f"WITH {ROWS} SELECT feature, year, quarter, round(ic, 6) AS ic, n FROM ({ic('rows_', 'feature, year, quarter')})"
SQL["mean_ic"] = f"WITH {ROWS} SELECT feature, round(avg(ic), 6) AS ic_mean FROM ({ic('rows_', 'feature, year, quarter', where=TEST)}) GROUP BY feature"
SQL["season_ic"] = f"WITH {ROWS} SELECT feature, year || 'Q' || quarter AS season, round(ic, 6) AS ic FROM ({ic('rows_', 'feature, year, quarter', where=TEST)})"
SQL["sector_ic"] = f"WITH {ROWS} SELECT feature, sector, round(ic, 6) AS ic FROM ({ic('rows_', 'feature, sector', where=TEST)})"
CONSISTENCY = f"SELECT m.feature, coalesce(avg(CASE WHEN s.ic IS NULL THEN NULL WHEN (s.ic > 0) = (m.ic >= 0) THEN 1.0 ELSE 0.0 END), 0) AS dc FROM (SELECT feature, avg(ic) AS ic FROM ({ic('rows_', 'feature, year, quarter', where=TEST)}) GROUP BY feature) m LEFT JOIN ({ic('rows_', 'feature, sector', where=TEST)}) s ON m.feature = s.feature GROUP BY m.feature"
SQL["direction_consistency"] = f"WITH {ROWS} SELECT feature, round(dc, 6) AS direction_consistency FROM ({CONSISTENCY})"
ZERO = "avg(CASE WHEN value IS NULL OR value = 0 THEN 1.0 ELSE 0.0 END)"
SQL["zero_ratio"] = f"WITH {ROWS} SELECT feature, round({ZERO}, 6) AS zero_ratio FROM rows_ GROUP BY feature"
BOUNDS = "SELECT feature, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM rows_ WHERE year IN (1995, 1996, 1997) GROUP BY feature"
CLIPPED = f"{ROWS}, clipped AS (SELECT r.* REPLACE (least(greatest(value, low), high) AS value) FROM rows_ r JOIN ({BOUNDS}) USING (feature))"
SQL["zero_by_sector"] = f"WITH {CLIPPED} SELECT feature, sector, round({ZERO}, 6) AS zero_ratio FROM clipped WHERE sector IS NOT NULL GROUP BY feature, sector"
SQL["zero_by_year"] = f"WITH {CLIPPED} SELECT feature, CAST(year(earnings_date) AS INTEGER) AS calendar, round({ZERO}, 6) AS zero_ratio FROM clipped GROUP BY 1, 2"
SQL["score_dist"] = f"WITH {CLIPPED} SELECT feature, round(value, 6) AS score, round(count(*) / sum(count(*)) OVER (PARTITION BY feature), 6) AS share FROM clipped WHERE value IS NOT NULL GROUP BY feature, value"
SEASONS = ic('clipped', 'feature, year, quarter', where=TEST)
SQL["validation_maps"] = f"""WITH {CLIPPED}, m AS (SELECT feature, 'per_sector_ic' AS map, sector AS key, ic AS value FROM ({ic('clipped', 'feature, sector', where=TEST)})
UNION ALL SELECT feature, 'season_ic', year || 'Q' || quarter, ic FROM ({SEASONS}) UNION ALL SELECT feature, 'zero_by_sector', sector, {ZERO} FROM clipped WHERE sector IS NOT NULL GROUP BY feature, sector
UNION ALL SELECT feature, 'zero_by_year', CAST(year(earnings_date) AS VARCHAR), {ZERO} FROM clipped GROUP BY feature, year(earnings_date)
UNION ALL SELECT feature, 'score_dist', CAST(CAST(round(value * 1000000) AS BIGINT) AS VARCHAR), count(*) / sum(count(*)) OVER (PARTITION BY feature) FROM clipped WHERE value IS NOT NULL GROUP BY feature, value)
SELECT feature, map, key, round(sum(value), 6) AS value FROM m GROUP BY feature, map, key"""
COVERAGE = f"SELECT f.feature, count(p.episode) AS n_test, (SELECT count(*) FROM panel WHERE {TEST}) AS n_panel FROM features f LEFT JOIN (SELECT * FROM panel WHERE {TEST}) p USING (episode) GROUP BY f.feature"
SQL["coverage"] = f"WITH {PANEL}, {FEATURES} SELECT feature, n_test, n_panel, round(n_test / n_panel, 6) AS coverage, n_test = 0 OR n_test / n_panel < 0.05 AS coverage_failure FROM ({COVERAGE})"
SQL["winsorize_bounds"] = f"WITH {ROWS} SELECT feature, round(low, 6) AS low, round(high, 6) AS high FROM ({BOUNDS})"
SQL["sketched_bounds"] = SQL["winsorize_bounds"]
SQL["winsorized_panel"] = f"WITH {ROWS} SELECT feature, episode, round(least(greatest(value, low), high), 6) AS value FROM rows_ JOIN ({BOUNDS}) USING (feature)"
SQL["zscore_panel"] = f"WITH {PANEL} SELECT episode, round({TARGET}, 6) AS target FROM panel"
SQL["sector_demean"] = f"WITH {PANEL} SELECT episode, round(({NEUTRAL}) / 7, 6) AS move_neutral FROM panel"
SQL["split_counts"] = f"WITH {PANEL} SELECT CASE WHEN year IN (1995, 1996, 1997) THEN 'train' WHEN year = 1998 THEN 'valid' WHEN {TEST} THEN 'test' END AS part, count(*) AS n FROM panel GROUP BY 1"
SQL["sector_encoding"] = f"WITH {PANEL} SELECT sector, CAST(dense_rank() OVER (ORDER BY sector) - 1 AS INTEGER) AS sector_code, n FROM (SELECT sector, count(*) AS n FROM panel GROUP BY sector)"
SQL["symbol_sector"] = f"WITH {PANEL} SELECT symbol, arg_min(sector, (earnings_date, episode)) AS sector FROM panel GROUP BY symbol"
SQL["symbol_year_filter"] = f"WITH {PANEL} SELECT episode, symbol, strftime(earnings_date, '%Y-%m-%d') AS day FROM panel WHERE symbol BETWEEN 1 AND 59 AND year(earnings_date) IN (1996, 1999)"
SQL["null_rate"] = f"WITH {PANEL}, {FEATURES} SELECT 'score' AS feature, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate FROM panel LEFT JOIN (SELECT * FROM features WHERE feature = 'score') f USING (episode)"
SQL["test_share"] = f"WITH {PANEL}, e AS (SELECT DISTINCT symbol, earnings_date FROM panel) SELECT count(*) AS n, count(*) FILTER (year(earnings_date) >= 1999) AS n_test, round(count(*) FILTER (year(earnings_date) >= 1999) / count(*), 6) AS share, count(*) FILTER (year(earnings_date) >= 1999) / count(*) < 0.1 AS warn FROM e"
SQL["validation_metrics"] = f"""WITH {ROWS}, b AS ({BOUNDS}), raw AS (SELECT * FROM rows_), clipped AS (SELECT r.* REPLACE (least(greatest(value, low), high) AS value) FROM raw r JOIN b USING (feature)),
c AS ({COVERAGE}), nw AS ({newey_west(ic('clipped', 'feature, year, quarter', where=TEST))}), zr AS (SELECT feature, {ZERO} AS zero_ratio FROM raw GROUP BY feature),
s AS ({ic('clipped', 'feature, sector', where=TEST)}), dc AS (SELECT nw.feature, avg(CASE WHEN (s.ic > 0) = (nw.ic_mean >= 0) THEN 1.0 ELSE 0.0 END) AS dc FROM nw JOIN s ON nw.feature = s.feature GROUP BY nw.feature)
SELECT c.feature, round(n_test / n_panel, 6) AS coverage, n_test / n_panel < 0.05 AS coverage_failure, round(ic_mean, 6) AS ic_mean, round(t_stat, 6) AS t_stat, n_quarters, round(zero_ratio, 6) AS zero_ratio, round(dc, 6) AS direction_consistency
FROM c JOIN nw USING (feature) JOIN zr USING (feature) JOIN dc USING (feature)"""
SQL["feature_wide"] = f"WITH {WIDE} SELECT episode, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)} FROM wide"
SQL["fusion_equal"] = f"WITH {WIDE} SELECT episode, round(fusion_equal, 6) AS fusion_equal, text_covered FROM fused"
SQL["fusion_icw"] = f"WITH {WIDE} SELECT episode, round(fusion_icw, 6) AS fusion_icw FROM fused"
SQL["single_factor_ic"] = f"WITH {WIDE} SELECT feature, round(ic_mean, 6) AS ic_mean, round(t_stat, 6) AS t_stat, n_quarters FROM ({newey_west(ic('scores', 'feature, year, quarter', 'move_neutral', where=TEST))})"
SQL["annual_ic"] = f"WITH {WIDE} SELECT feature, year, round(ic, 6) AS ic, n FROM ({ic('scores', 'feature, year', 'move_neutral', 10)})"
SQL["valid_year_ic"] = f"WITH {WIDE} SELECT feature, round(ic, 6) AS ic, n FROM ({ic('scores', 'feature, year', 'move_neutral', 10, 'year = 1998')})"
SQL["covered_ic"] = f"WITH {WIDE}, a AS ({newey_west(ic('scores', 'feature, year, quarter', 'move_neutral', where=TEST))}), c AS ({newey_west(ic('scores', 'feature, year, quarter', 'move_neutral', where=TEST + ' AND text_covered'))}) SELECT c.feature, round(c.ic_mean, 6) AS ic_mean, round(a.ic_mean, 6) AS ic_all, round(c.ic_mean - a.ic_mean, 6) AS delta FROM c JOIN a USING (feature)"
SQL["fusion_report"] = f"WITH {WIDE}, a AS ({newey_west(ic('scores', 'feature, year, quarter', 'move_neutral', where=TEST))}), c AS ({newey_west(ic('scores', 'feature, year, quarter', 'move_neutral', where=TEST + ' AND text_covered'))}), v AS ({ic('scores', 'feature, year', 'move_neutral', 10, 'year = 1998')}) SELECT a.feature, round(a.ic_mean, 6) AS ic_mean, round(a.t_stat, 6) AS t_stat, a.n_quarters, round(c.ic_mean, 6) AS ic_covered, round(c.ic_mean - a.ic_mean, 6) AS delta, round(v.ic, 6) AS ic_valid FROM a LEFT JOIN c USING (feature) LEFT JOIN v USING (feature)"
PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS l, '{b}' AS r, {a} AS x, {b} AS y FROM wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(NAMES) for b in NAMES[i:])
SQL["spearman_matrix"] = f"""WITH {WIDE}, p AS ({PAIRS}), k AS (SELECT l, r, rank() OVER (PARTITION BY l, r ORDER BY x) + (count(*) OVER (PARTITION BY l, r, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l, r ORDER BY y) + (count(*) OVER (PARTITION BY l, r, y) - 1) / 2.0 AS b FROM p)
SELECT l AS "left", r AS "right", round(corr(a, b), 6) AS rho FROM k GROUP BY l, r"""

RESULTS = """li AS (SELECT l_suppkey AS k, 's' || (l_linenumber % 5) AS sector, CAST(year(l_shipdate) AS VARCHAR) AS yr, CASE WHEN (l_partkey * 7) % 10 < l_suppkey % 10 THEN 1 ELSE 0 END AS zero, (l_partkey % 7) - 3 AS x, ((l_partkey % 5) - 2) || '.0' AS score FROM lineitem),
base AS (SELECT k, count(*) AS n, CAST(sum(zero) AS DOUBLE) / count(*) AS zero_ratio, CAST(sum(x) AS DOUBLE) / count(*) AS ic_mean FROM li GROUP BY k),
sec AS (SELECT k, sector, CAST(sum(zero) AS DOUBLE) / count(*) AS z, CAST(sum(x) AS DOUBLE) / count(*) AS x FROM li GROUP BY k, sector),
yrs AS (SELECT k, yr, CAST(sum(zero) AS DOUBLE) / count(*) AS z FROM li GROUP BY k, yr),
dist AS (SELECT k, score, count(*) * 1.0 / any_value(n) AS share FROM li JOIN base USING (k) GROUP BY k, score),
agg AS (SELECT k, count(*) AS n_sec, var_samp(z) AS var, avg(z) AS mean, max(z) AS hi, min(z) AS lo FROM sec GROUP BY k),
res AS (SELECT 'f' || k || CASE WHEN k % 9 = 4 THEN '_v2' ELSE '' END AS feature, k, k % 13 = 0 AS cf, CASE WHEN k % 13 = 0 THEN 0.01 ELSE 0.5 END AS coverage, zero_ratio, ic_mean, ic_mean * (k % 50) AS t_stat, (k % 11) / 10.0 AS dc,
  CASE WHEN n_sec < 3 THEN 'unknown' WHEN var < 0.02 THEN CASE WHEN mean > 0.70 THEN 'systemic_sparse' ELSE 'uniform' END WHEN hi > 0.80 AND lo < 0.40 THEN 'concentrated' ELSE 'unknown' END AS zt,
  n_sec >= 3 AND var < 0.02 AS even, (SELECT coalesce(sum(share), 0) FROM dist WHERE dist.k = base.k AND score IN ('2.0', '-2.0')) AS polar, coalesce((SELECT max(share) FROM dist WHERE dist.k = base.k AND score = '0.0'), 0) AS zero_scores,
  (SELECT max(share) FROM dist WHERE dist.k = base.k) AS top, (SELECT count(*) FROM yrs WHERE yrs.k = base.k AND z > 0.60 AND CAST(yr AS INTEGER) <= 2017) AS early FROM base JOIN agg USING (k))"""
FAILED = "CASE WHEN cf THEN 'G1_coverage' ELSE concat_ws(',', CASE WHEN zero_ratio >= CASE WHEN zt = 'uniform' THEN 0.70 ELSE 0.45 END THEN 'G2_zero_ratio' END, CASE WHEN abs(t_stat) < 1.5 THEN 'G3_t_stat' END, CASE WHEN dc < 0.60 THEN 'G4_direction' END) END"
SQL["zero_type"] = f"WITH {RESULTS} SELECT feature, zt AS zero_type FROM res"
SQL["governance"] = f"WITH {RESULTS} SELECT feature, failed = '' AS passed, failed FROM (SELECT feature, {FAILED} AS failed FROM res)"
SQL["gate_matrix"] = f"""WITH {RESULTS}, g AS (SELECT feature, NOT cf AND coverage >= 0.05 AS g1, zero_ratio < CASE WHEN even THEN 0.70 ELSE 0.45 END AS g2, abs(t_stat) >= 1.5 AS g3, dc >= 0.60 AS g4 FROM res)
SELECT *, CASE WHEN NOT g1 THEN 'G1_coverage' WHEN NOT g2 THEN 'G2_zero_ratio' WHEN NOT g3 THEN 'G3_t_stat' WHEN NOT g4 THEN 'G4_direction' END AS failed_by, g1 AND g2 AND g3 AND g4 AS gates_passed FROM g"""
SQL["gate_failures"] = f"""WITH {RESULTS}, g AS (SELECT feature, k, k % 10 = 3 AS blocked, NOT cf AND coverage >= 0.05 AS g1, zero_ratio < CASE WHEN even THEN 0.70 ELSE 0.45 END AS g2, abs(t_stat) >= 1.5 AS g3, dc >= 0.60 AS g4, k % 4 = 0 OR (k % 9) / 100.0 <= 0.03 AS g5 FROM res),
n AS (SELECT *, CASE WHEN blocked THEN ['known'] ELSE list_filter([CASE WHEN NOT g1 THEN 'G1_coverage' END, CASE WHEN NOT g2 THEN 'G2_zero_ratio' END, CASE WHEN NOT g3 THEN 'G3_t_stat' END, CASE WHEN NOT g4 THEN 'G4_direction' END, CASE WHEN NOT g5 THEN 'G5_max_drawdown' END], lambda x: x IS NOT NULL) END AS f FROM g)
SELECT feature, CASE WHEN blocked THEN 'known' END AS blocked_by, CASE WHEN NOT blocked THEN f[1] END AS failed_by, array_to_string(f, ',') AS failed, len(f) = 0 AS gates_passed, CASE WHEN list_contains(f, 'G2_zero_ratio') THEN 'zeros of ' || feature END AS sparse,
  CASE WHEN len(f) > 0 THEN CAST(len(f) AS VARCHAR) END AS n_failed FROM n"""
SQL["gate_executor"] = f"""WITH {RESULTS}, g AS (SELECT feature, k % 10 = 3 AS blocked, {FAILED} AS failed, CASE WHEN cf OR coverage < 0.05 THEN 'G1_coverage' WHEN zero_ratio >= CASE WHEN even THEN 0.70 ELSE 0.45 END THEN 'G2_zero_ratio' WHEN abs(t_stat) < 1.5 THEN 'G3_t_stat' WHEN dc < 0.60 THEN 'G4_direction' END AS first FROM res)
SELECT feature, CASE WHEN blocked THEN 'known' END AS blocked_by, CASE WHEN NOT blocked THEN failed = '' END AS passed, CASE WHEN NOT blocked THEN first END AS failed_by, NOT blocked AND first IS NULL AS gates_passed FROM g"""
SQL["reversed_sectors"] = f"WITH {RESULTS}, o AS (SELECT res.feature, sector, row_number() OVER (PARTITION BY res.k ORDER BY sector) AS i FROM res JOIN sec USING (k) WHERE (x < 0 AND ic_mean >= 0) OR (x > 0 AND ic_mean < 0)) SELECT feature, coalesce(string_agg(sector, ',' ORDER BY i), '') AS sectors FROM res LEFT JOIN (SELECT * FROM o WHERE i <= 5) USING (feature) GROUP BY feature"
SQL["worst_sectors"] = f"WITH {RESULTS}, o AS (SELECT k, sector, row_number() OVER (PARTITION BY k ORDER BY z DESC, sector) AS i FROM sec) SELECT feature, string_agg(sector, ',' ORDER BY i) AS worst, round(any_value(polar), 6) AS polar FROM res JOIN o USING (k) WHERE i <= 3 GROUP BY feature"
SQL["rag_queries"] = f"""WITH {RESULTS}, q AS (SELECT feature, cf, CASE WHEN zero_ratio >= 0.45 THEN CASE WHEN abs(t_stat) >= 1.5 THEN '{G.QUERY_SPARSE}' ELSE '{G.QUERY_AMBIGUOUS}' END END AS a,
  CASE WHEN abs(t_stat) < 1.5 AND zero_ratio < 0.45 AND abs(ic_mean) < 0.04 THEN CASE WHEN polar > 0.65 THEN '{G.QUERY_BIMODAL}' ELSE '{G.QUERY_WEAK}' END END AS b, CASE WHEN dc < 0.60 THEN '{G.QUERY_SECTOR}' END AS c FROM res)
SELECT feature, CASE WHEN cf THEN '{G.QUERY_COVERAGE}' WHEN a IS NULL AND b IS NULL AND c IS NULL THEN '{G.QUERY_DEFAULT}' WHEN a IS NOT NULL AND b IS NOT NULL THEN concat_ws(' || ', a, b) ELSE concat_ws(' || ', a, b, c) END AS queries FROM q"""
SALVAGE = f"""{RESULTS}, gov AS (SELECT *, {FAILED} AS failed FROM res), tried AS (SELECT feature FROM gov WHERE k % 6 = 1),
sal AS (SELECT *, NOT cf AND feature NOT LIKE '%\\_v2' ESCAPE '\\' AND feature NOT IN (SELECT feature FROM tried) AND ((abs(ic_mean) > 0.08 AND abs(t_stat) > 2.0 AND failed = 'G2_zero_ratio' AND (zt <> 'uniform' OR (zero_ratio < 0.30 AND abs(ic_mean) > 0.03 AND abs(t_stat) > 1.0)))
  OR (zero_ratio < 0.30 AND abs(ic_mean) > 0.03 AND abs(t_stat) > 1.0)) AS salvageable FROM gov)"""
SQL["salvageable"] = f"WITH {SALVAGE} SELECT feature, salvageable FROM sal"
SQL["salvage_report"] = f"""WITH {SALVAGE} SELECT feature, salvageable, CASE WHEN salvageable THEN NULL WHEN feature LIKE '%\\_v2' ESCAPE '\\' THEN 'already repaired' WHEN abs(ic_mean) <= 0.08 THEN 'weak ic' WHEN abs(t_stat) <= 2.0 THEN 'weak t' WHEN zt = 'uniform' THEN 'uniform zeros' ELSE 'tried before' END AS blocker FROM sal WHERE failed = 'G2_zero_ratio' AND NOT cf"""
SQL["failure_mode"] = f"""WITH {RESULTS} SELECT feature, CASE WHEN cf THEN 'G1' WHEN k % 4 = 0 AND abs(ic_mean) < 0.03 THEN 'F' WHEN zero_ratio > 0.50 OR zero_scores > 0.55 THEN 'A' WHEN polar > 0.65 AND abs(ic_mean) < 0.04 THEN 'B' WHEN early >= 2 THEN 'E' WHEN dc < 0.60 THEN 'D'
  WHEN abs(ic_mean) < 0.02 AND zero_ratio < 0.20 AND abs(t_stat) < 0.8 THEN CASE WHEN k % 3 = 0 THEN 'G' ELSE 'C' END WHEN abs(t_stat) < 1.5 AND zero_ratio < 0.35 AND top < 0.60 THEN 'C' ELSE 'edge' END AS mode FROM res"""
FIXES = ", ".join(f"('{k}', '{v}')" for k, v in G.FALLBACK_FIX.items())
SQL["rule_diagnoses"] = f"SELECT feature, mode, fix, '' AS avoid, 'rule' AS source FROM ({SQL['failure_mode']}) JOIN (VALUES {FIXES}) AS x(mode, fix) USING (mode)"

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
CHUNKS = "chunks AS (SELECT vec_id AS chunk_id, embedding, CASE WHEN label % 2 = 0 THEN 'qa' ELSE 'prepared' END AS section_type, CASE WHEN label % 3 = 0 THEN 'analyst' ELSE 'mgmt' END AS speaker_role, 's' || (label % 5) AS sector, CAST(floor(vec_id / 7) AS BIGINT) AS episode, CAST(floor(vec_id / 3) AS BIGINT) AS page_num FROM embeddings)"


def scored(vec_id: int) -> str:
    return f"{CHUNKS}, scored AS (SELECT *, {DOT.format(a='embedding', b=f'(SELECT embedding FROM embeddings WHERE vec_id = {vec_id})')} AS score FROM chunks)"


SQL["vector_topk"] = f"WITH {scored(0)} SELECT chunk_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, chunk_id LIMIT 10"
SQL["scoped_topk"] = f"WITH {scored(1)}, f AS (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 60) SELECT chunk_id, section_type, round(score, 6) AS score FROM f WHERE section_type = 'qa' AND speaker_role = 'mgmt' ORDER BY f.score DESC, chunk_id LIMIT 20"
SQL["sector_topk"] = f"WITH {scored(2)}, f AS (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 100) SELECT chunk_id, round(score, 6) AS score FROM f WHERE sector = 's1' ORDER BY f.score DESC, chunk_id LIMIT 20"
SQL["multi_query_topk"] = f"""WITH {CHUNKS}, p AS (SELECT c.*, q.vec_id AS qid, {DOT.format(a='c.embedding', b='q.embedding')} AS score FROM chunks c, (SELECT * FROM embeddings WHERE vec_id IN (3, 4)) q),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) <= 4), o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY page_num ORDER BY score DESC, qid, chunk_id) = 1)
SELECT page_num, chunk_id, round(score, 6) AS score FROM o ORDER BY o.score DESC, chunk_id LIMIT 8"""
SQL["memory_topk"] = f"WITH {scored(5)}, f AS (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 5) SELECT chunk_id, round(score, 6) AS score FROM f WHERE f.score > 0.1"
SQL["vector_norms"] = f"WITH n AS (SELECT vec_id, embedding, sqrt({DOT.format(a='embedding', b='embedding')}) AS len FROM embeddings) SELECT vec_id AS chunk_id, round(embedding[1] / len, 6) AS first, round(1.0::DOUBLE, 6) AS norm FROM n"
SQL["pooled_vectors"] = f"""WITH t AS (SELECT vec_id, embedding AS e, CASE WHEN label % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS m FROM embeddings), p AS (SELECT vec_id, e[16] AS first, list_transform(range(1, 17), lambda i: (e[i]::DOUBLE + e[i + 16] + e[i + 32] * m + e[i + 48]) / (3 + m)) AS mean FROM t)
SELECT vec_id, round(first, 6) AS first, round(mean[4], 6) AS mean, round(mean[4] / sqrt(list_sum(list_transform(mean, lambda x: x * x))), 6) AS unit FROM p"""
SQL["episode_head"] = f"WITH {scored(0)}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY episode ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored) SELECT episode, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 3"
SQL["batch_assign"] = f"WITH {PANEL} SELECT episode, CAST(floor((row_number() OVER (ORDER BY symbol, episode) - 1) / 50) AS BIGINT) AS batch FROM panel"
QUOTA = "SELECT year, count(*) AS n, CAST(greatest(1, round_even(400 * count(*) / (SELECT count(*) FROM panel), 0)) AS INTEGER) AS quota FROM panel GROUP BY year"
SQL["stratified_quota"] = f"WITH {PANEL} {QUOTA}"
SQL["stratified_sample"] = f"WITH {PANEL} SELECT year, CAST(least(quota, n) AS BIGINT) AS n FROM ({QUOTA})"

RECORDS = """rec AS (SELECT p_partkey AS line_no, 'feat_' || (p_partkey // 2) || CASE WHEN p_partkey % 2 = 1 THEN '_v2' ELSE '' END AS feature, CASE WHEN p_partkey % 2 = 1 THEN 'feat_' || (p_partkey // 2) END AS repair_of, p_name AS definition, p_size / 100.0 AS ic_mean, p_size / 10.0 AS t_stat,
  (p_partkey % 10) / 10.0 AS zero_ratio, (p_partkey % 4) / 4.0 AS direction_consistency, list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'G2_zero_ratio: ' || p_brand END, CASE WHEN p_partkey % 5 = 0 THEN 'G3_t_stat: weak' END, CASE WHEN p_partkey % 7 = 0 THEN 'something long without a colon in it' END], lambda f: f IS NOT NULL) AS failures,
  p_type AS cluster, 'fix ' || p_type AS diagnosis_fix, 'root of ' || p_brand AS diagnosis_root_cause FROM part), records AS (SELECT *, len(failures) = 0 AS passed, CASE WHEN len(failures) = 0 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM rec)"""
SQL["keyword_search"] = f"WITH {RECORDS}, t AS (SELECT line_no, lower(concat_ws(' ', definition, feature, array_to_string(failures, ' '))) AS x FROM records), k AS (SELECT line_no, {' + '.join(f'CAST(contains(x, $${w}$$) AS BIGINT)' for w in ('g2_zero', 'weak', 'feat_12', 'brand#1'))} AS score FROM t) SELECT * FROM k WHERE score > 0 ORDER BY score DESC, line_no LIMIT 5"
SEARCHES = f"""{RECORDS}, t AS (SELECT line_no, lower(concat_ws(' ', definition, feature, array_to_string(failures, ' '))) AS x FROM records),
  q AS (SELECT DISTINCT p_name || '/' || p_brand AS query_id, unnest(list_distinct(string_split(lower(p_name || ' ' || p_brand || ' G3_t 7 FEAT_' || length(p_name) || ' absent'), ' '))) AS word FROM part), w AS (SELECT DISTINCT word FROM q)"""
SQL["memory_search"] = f"""WITH {SEARCHES}, h AS (SELECT word, line_no FROM w JOIN t ON contains(x, word)), s AS (SELECT query_id, line_no, count(*) AS score FROM q JOIN h USING (word) GROUP BY query_id, line_no)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, line_no) AS rank, line_no, score FROM s QUALIFY rank <= 3"""
SQL["memory_postings"] = f"""WITH {SEARCHES}, p AS (SELECT DISTINCT substr(x || chr(1) || chr(1), i, 3) AS gram, line_no FROM (SELECT x, line_no, unnest(range(1, length(x) + 1)) AS i FROM t)), c AS (SELECT gram, count(*) AS n FROM p GROUP BY gram),
  g AS (SELECT word, unnest(list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3))) AS gram FROM w WHERE length(word) >= 3), f AS (SELECT word, min(n) AS n, bool_and(n IS NOT NULL) AS whole FROM g LEFT JOIN c USING (gram) GROUP BY word)
SELECT word, 1::BIGINT AS lists, CAST(n AS BIGINT) AS postings FROM f WHERE whole UNION ALL SELECT word, count(*), CAST(sum(n) AS BIGINT) FROM w JOIN c ON starts_with(gram, word) WHERE length(word) < 3 GROUP BY word"""


def sql_regex(p: str) -> str:
    return p.replace("'", "''")


QA = " OR ".join(f"contains(lower(x), '{sql_regex(w)}')" for w in T.QA_WORDS)
SQL["prompt_text"] = f"WITH c AS (SELECT conv_id, turn, text AS x, role FROM conversations) SELECT conv_id, string_agg('[' || CASE WHEN {QA} THEN 'qa' ELSE 'prepared' END || '/' || CASE WHEN role = '' THEN 'unknown' WHEN contains(lower(role), 'operator') THEN 'operator' ELSE 'mgmt' END || '] ' || left(x, 40), chr(10) ORDER BY turn) AS prompt FROM c GROUP BY conv_id"
SQL["section_type"] = f"WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || ' Your Question please' ELSE text END AS x FROM conversations) SELECT conv_id, turn, CASE WHEN {QA} THEN 'qa' ELSE 'prepared' END AS section_type FROM c"
CALLS = "tr AS (SELECT conv_id AS symbol, string_agg(CASE role WHEN 'user' THEN 'Analyst Capital' WHEN 'assistant' THEN 'Chief Officer' ELSE 'Operator' END || ': ' || replace(text, chr(10), ' '), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)"
SQL["qa_boundary"] = f"""WITH {CALLS}, o AS (SELECT symbol, CASE WHEN symbol % 3 = 0 THEN t || chr(10) || 'Questions and Answers' || chr(10) || 'Analyst: thanks' WHEN symbol % 3 = 1 THEN 'We will now begin the question round' || chr(10) || t ELSE t END AS t FROM tr),
l AS (SELECT symbol, string_split(t, chr(10)) AS ls FROM o), f AS (SELECT symbol, ls, list_position(list_transform(ls, lambda x: {' OR '.join(f"regexp_matches(x, '{sql_regex(p)}')" for p in T.QA_BOUNDARY)}), true) AS p FROM l)
SELECT symbol, CASE WHEN p > 0 THEN CAST(p - 1 AS INTEGER) END AS line, CAST(CASE WHEN p > 0 THEN length(trim(array_to_string(ls[p:], chr(10)))) ELSE 0 END AS INTEGER) AS qa_chars FROM f"""
SQL["speaker_role"] = f"""WITH c AS (SELECT doc_id, ['', 'Q - Jo', 'The Operator', 'Ann Lee, Morgan Stanley', 'Sue Roe, CFO', 'Sam'][doc_id % 6 + 1] || CASE WHEN n_chars % 5 > 0 THEN text ELSE '' END AS x FROM documents)
SELECT doc_id, CASE WHEN x = '' THEN 'unknown' WHEN regexp_matches(x, '{T.ANALYST_PREFIX}') THEN 'analyst' WHEN contains(lower(x), 'operator') THEN 'operator' WHEN regexp_matches(x, '{T.ANALYST_FIRMS}') THEN 'analyst' ELSE 'mgmt' END AS role FROM c"""
SPLIT = "list_filter(string_split_regex({x}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda s: true)"
SQL["noise_lines"] = f"""WITH d AS (SELECT doc_id, {SPLIT.format(x="coalesce(text, '') || chr(10) || 'Form 8-K' || chr(10) || 'see report.pdf' || chr(10) || '$1,2,3,4 12,000' || chr(10)")}[:-2] AS ls FROM documents), l AS (SELECT doc_id, regexp_replace(unnest(ls), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g') AS s FROM d)
SELECT doc_id, count(*) AS lines, count(*) FILTER (s = '' OR (length(s) < 120 AND regexp_matches(s, '{T.RELEASE_NOISE}')) OR (length(s) < 200 AND regexp_matches(s, '{T.FILE_NAME}')) OR (length(s) > 20 AND length(regexp_replace(s, '\\P{{L}}', '', 'g')) / length(s) < 0.25)
  OR (regexp_matches(s, '^\\s*[$\\d(\\-]') AND length(regexp_replace(s, '[^$,]', '', 'g')) > 3)) AS noise FROM l GROUP BY doc_id"""
SQL["paper_lines"] = f"""WITH d AS (SELECT doc_id, {SPLIT.format(x="coalesce(text, '') || chr(10) || 'References' || chr(10) || 'doi:10.1' || chr(10) || '12 ' || chr(10)")}[:-2] AS ls FROM documents), l AS (SELECT doc_id, trim(unnest(ls)) AS s FROM d)
SELECT doc_id, count(*) FILTER (regexp_matches(s, '{T.PAPER_NOISE}')) AS noise FROM l GROUP BY doc_id"""
SQL["score_parse"] = """WITH o AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
SELECT k AS episode, CASE WHEN c % 2 = 0 THEN 0.5 ELSE CAST(least(greatest(c % 7 - 3, -2), 2) AS DOUBLE) END AS s1, least(CAST(c % 4 AS DOUBLE) + (c % 90 + 10) / 100.0, 2) AS s2, CAST(0 - (k % 10) / 10.0 AS DOUBLE) AS s3, CAST(NULL AS DOUBLE) AS s4, CAST(1 AS DOUBLE) AS first FROM o"""
SQL["token_estimate"] = """WITH d AS (SELECT doc_id, coalesce(text, '') || '营收增长' AS x FROM documents), t AS (SELECT doc_id, x, CAST(floor(length(regexp_replace(x, '[^一-鿿]', '', 'g')) * 1.5 + (length(x) - length(regexp_replace(x, '[^一-鿿]', '', 'g'))) / 4.0) AS INTEGER) AS tokens FROM d)
SELECT doc_id, tokens, CASE WHEN tokens <= 100 THEN length(x) ELSE CAST(floor(length(x) * (100.0::DOUBLE / tokens) * 0.9) AS INTEGER) + 19 END::INTEGER AS cut_chars FROM t"""
SQL["name_normalise"] = """WITH n AS (SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[a-z][a-z0-9_]+$') THEN p_name ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') END AS name FROM part)
SELECT p_partkey, name, CASE WHEN name IN ('part_1', 'part_2') THEN name || '_v2' ELSE name END AS unique_name, name AS base, ['+', '-', '+', '+', '-'][p_partkey % 5 + 1] AS direction FROM n"""
SQL["reply_parse"] = """SELECT p_partkey, '{"a": ' || p_partkey || '}' AS json, 'c' || p_partkey AS cause, 'f' || p_partkey AS fix, '' AS avoid, 'IC=+0.1' || p_partkey || ' t=-2.5 zr=30%' AS metrics FROM part"""
SQL["argument_masks"] = """SELECT p_partkey, '***' AS key, CAST(CASE WHEN length(p_name) * 30 > 200 THEN 203 ELSE length(p_name) * 30 END AS INTEGER) AS text_chars, 2 AS n_args, p_partkey % 3 = 0 OR p_partkey % 4 IN (0, 3) AS again, CAST(CASE WHEN length(p_name) * 20 > 200 THEN 203 ELSE length(p_name) * 20 END AS INTEGER) AS summary_chars FROM part"""
SQL["chunk_counts"] = f"WITH c AS (SELECT text AS x, role FROM conversations) SELECT CASE WHEN {QA} THEN 'qa' ELSE 'prepared' END AS section_type, CASE WHEN role = '' THEN 'unknown' WHEN contains(lower(role), 'operator') THEN 'operator' ELSE 'mgmt' END AS speaker_role, count(*) AS n, round(avg(length(x)), 6) AS mean_length FROM c GROUP BY 1, 2"
SQL["paper_counts"] = "SELECT source AS paper_title, count(*) AS n FROM documents GROUP BY source"
SQL["chunk_ids"] = "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS chunk_id FROM conversations WHERE length(text) >= 60"
WORDS = "len(regexp_extract_all(lower(x), '\\b({words})'))"
SQL["lexicon_scores"] = f"""WITH d AS (SELECT doc_id, text || [' strong Growth', ' weak risk lower', '', ' exceeds, records MISSED. Raised'][n_chars % 4 + 1] AS x FROM documents)
SELECT doc_id, CASE WHEN trim(x) <> '' THEN CAST(least(greatest({WORDS.format(words='|'.join(S.POSITIVE))} - {WORDS.format(words='|'.join(S.NEGATIVE))}, -2), 2) AS DOUBLE) END AS value FROM d"""

STEPS = """steps AS (SELECT user_id AS run_id, event_id AS step_id, event_type AS state, event_id % 5 AS iteration, CASE WHEN event_type <> 'view' THEN event_type END AS tool, value AS ms, event_type <> 'error' AS ok, CAST(regexp_extract(props, '(-?\\d+)', 1) AS INTEGER) AS k,
  CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'signup' THEN 'RETRY' ELSE 'CONTINUE' END AS decision FROM events)"""
SQL["trace_stats"] = f"""WITH {STEPS} SELECT run_id, count(*) AS total_steps, max(step_id) AS total_iterations, CAST(sum(k) AS BIGINT) AS total_tokens, round(sum(coalesce(ms, 0)), 4) AS total_latency_ms, round(coalesce(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) FILTER (tool IS NOT NULL), 1.0), 6) AS tool_success_rate,
  round(coalesce(count(*) / nullif(count(DISTINCT CASE WHEN iteration > 0 THEN iteration END), 0), 0), 6) AS avg_steps_per_iteration, count(*) FILTER (k % 4 = 0) AS "G1_coverage", count(*) FILTER (k % 4 = 1) AS "G2_zero_ratio", CAST(0 AS BIGINT) AS "G3_t_stat", count(*) FILTER (k % 4 = 3) AS "G4_direction" FROM steps GROUP BY run_id"""
SQL["states_visited"] = f"WITH {STEPS}, f AS (SELECT run_id, state, min(step_id) AS first FROM steps GROUP BY 1, 2) SELECT run_id, string_agg(state, '>' ORDER BY first) AS states FROM f GROUP BY run_id"
SQL["decision_counts"] = f"WITH {STEPS} SELECT run_id, decision, count(*) AS n FROM steps GROUP BY 1, 2"
SQL["tool_metrics"] = f"WITH {STEPS} SELECT tool AS tool_called, count(*) AS calls, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(ms), 4) AS mean_latency_ms FROM steps WHERE tool IS NOT NULL GROUP BY 1"
SQL["divergence_point"] = f"WITH {STEPS} SELECT run_id, min(step_id) AS step_id, arg_min(state, step_id) AS state, arg_min(decision, step_id) AS decision FROM steps WHERE NOT ok OR decision IN ('FAIL', 'RETRY') GROUP BY run_id"
SQL["trace_metrics"] = f"WITH {STEPS} SELECT DISTINCT run_id, 'IC=0.0123 t=-1.50 zr=45.5%' AS key_metrics FROM steps WHERE k % 4 = 3"
SQL["step_lines"] = f"WITH {STEPS} SELECT step_id, concat_ws(' ', '[Step' || step_id || '|' || state || ']', tool || CASE WHEN ok THEN '✓' ELSE '✗' END, CASE WHEN coalesce(ms, 0) <> 0 THEN printf('%.0fms', ms) END, '→' || decision, CASE WHEN NOT ok THEN 'err=it failed' END) AS line FROM steps"
SQL["failure_patterns"] = f"WITH {RECORDS}, r AS (SELECT * FROM records ORDER BY line_no DESC LIMIT 50), f AS (SELECT unnest(failures) AS f FROM r), k AS (SELECT CASE WHEN contains(f, ':') THEN string_split(f, ':')[1] ELSE left(f, 20) END AS failure FROM f) SELECT failure, count(*) AS n FROM k GROUP BY failure ORDER BY n DESC, failure LIMIT 3"
SQL["pass_rate"] = f"WITH {RECORDS} SELECT round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, count(*) AS n FROM records"
SQL["recent_failures"] = f"WITH {RECORDS} SELECT line_no, feature FROM records WHERE line_no % 5 = 0 ORDER BY line_no DESC LIMIT 4"
SQL["episode_lines"] = f"WITH {RECORDS} SELECT line_no, concat_ws(' | ', 'Feature: ' || feature, 'Definition: ' || definition, 'Outcome: ' || outcome, CASE WHEN NOT passed THEN 'Failures: ' || array_to_string(failures, ', ') END, CASE WHEN NOT passed THEN 'Root Cause: ' || diagnosis_root_cause END, CASE WHEN NOT passed THEN 'Fix: ' || diagnosis_fix END, CASE WHEN passed THEN printf('IC=%+.4f t=%+.3f', ic_mean, t_stat) END) AS line FROM records"
SQL["patch_merge"] = f"WITH {RECORDS}, p AS (SELECT 'feat_' || (line_no % 40) AS feature, arg_max(diagnosis_fix, line_no) AS diagnosis FROM records GROUP BY 1) SELECT feature, line_no, diagnosis FROM records LEFT JOIN p USING (feature)"
SQL["unexplored_anti"] = f"WITH {RECORDS} SELECT 'feat_' || (line_no % 300) AS feature, min(line_no) AS line_no FROM records WHERE 'feat_' || (line_no % 300) NOT IN (SELECT feature FROM records WHERE ic_mean > 0.25) GROUP BY 1"
SQL["queue_order"] = f"WITH {RECORDS}, q AS (SELECT feature, 0 AS p, line_no, 'seed' AS source FROM records WHERE repair_of IS NULL UNION ALL SELECT feature, 1, line_no, 'repair' FROM records WHERE repair_of IS NOT NULL) SELECT feature, arg_min(source, (p, line_no)) AS source, arg_min(line_no, (p, line_no)) AS line_no FROM q WHERE feature NOT IN (SELECT feature FROM records WHERE ic_mean > 0.4) GROUP BY feature"
SQL["lineage_compare"] = f"""WITH {RECORDS}, l AS (SELECT n.repair_of, o.ic_mean AS oi, n.ic_mean AS ni, o.zero_ratio AS oz, n.zero_ratio AS nz, o.direction_consistency AS od, n.direction_consistency AS nd FROM records n JOIN records o ON n.repair_of = o.feature),
m AS (SELECT repair_of, 'ic_mean' AS metric, oi AS old, ni AS new, ni > oi AS better FROM l UNION ALL SELECT repair_of, 'zero_ratio', oz, nz, nz < oz FROM l UNION ALL SELECT repair_of, 'direction_consistency', od, nd, nd > od FROM l)
SELECT repair_of, metric, round(CAST(old AS DOUBLE), 6) AS old, round(CAST(new AS DOUBLE), 6) AS new, round(CAST(new AS DOUBLE) - CAST(old AS DOUBLE), 6) AS delta, better FROM m"""
SQL["exploration_summary"] = f"WITH {RECORDS} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM records"
SQL["passed_names"] = f"WITH {RECORDS} SELECT line_no, feature FROM records WHERE passed"
SQL["first_records"] = f"WITH {RECORDS} SELECT replace(feature, '_v2', '') AS feature, min(line_no) AS line_no, arg_min(definition, line_no) AS definition, arg_min_null(repair_of, line_no) AS repair_of FROM records GROUP BY 1"
SQL["least_used_cluster"] = f"WITH {RECORDS}, c AS (SELECT cluster, min(line_no) AS place FROM records GROUP BY 1), u AS (SELECT c.cluster, place, count(r.line_no) AS n FROM c LEFT JOIN records r ON c.cluster = r.cluster GROUP BY 1, 2) SELECT arg_min(cluster, (n, place)) AS cluster FROM u"
SQL["feature_dedup"] = f"WITH {RECORDS} SELECT replace(feature, '_v2', '') AS feature, max(line_no) AS line_no, arg_max(definition, line_no) AS definition FROM records GROUP BY 1"
SQL["metadata_upsert"] = "SELECT p_partkey AS chunk_id, CASE WHEN p_size <= 30 THEN p_name ELSE 'new' END AS p_name FROM part WHERE p_size <= 30 OR p_size > 20"
SQL["index_resume"] = "SELECT p_partkey AS chunk_id, p_name FROM part WHERE p_size > 30"
SQL["signal_counts"] = f"WITH {FEATURES} SELECT feature, count(*) FILTER (value = 0) AS without, count(*) FILTER (value <> 0) AS with_signal, round(sum(least(greatest(value, -1), 1)), 4) AS clipped FROM features GROUP BY feature"
SQL["recent_window"] = f"WITH {STEPS} SELECT run_id, step_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY step_id DESC) AS INTEGER) AS r FROM steps QUALIFY r <= 3"
SQL["ranked_candidates"] = f"WITH {RECORDS} SELECT feature, passed, round(CAST(ic_mean AS DOUBLE), 6) AS ic_mean FROM records ORDER BY passed DESC, records.ic_mean DESC, feature LIMIT 10"
LAST = "(SELECT * FROM records ORDER BY line_no DESC LIMIT {n})"
SQL["memory_hint"] = f"""WITH {RECORDS}, r AS {LAST.format(n=4)}, c AS (SELECT count(*) AS n, count(*) FILTER (NOT passed) AS f, count(*) FILTER (line_no % 3 = 0) AS g2, count(*) FILTER (line_no % 5 = 0) AS g3,
  string_agg('  [' || outcome || '] ' || feature || ': ' || outcome || printf(' (IC=%+.3f, zr=%.0f%%)', ic_mean, zero_ratio * 100) || chr(10) || '     Fix applied: ' || left(diagnosis_fix, 120), chr(10) ORDER BY line_no) AS said FROM r)
SELECT concat_ws(chr(10), '[Episodic Memory — Lessons from Similar Past Features]', CASE WHEN f >= 2 THEN 'WARNING: ' || f || '/' || n || ' similar past features FAILED.' END, CASE WHEN f >= 2 AND g2 >= 2 THEN '-> Common issue: High zero-ratio. Consider finer-grained scoring intervals.' END,
  CASE WHEN f >= 2 AND g3 >= 2 THEN '-> Common issue: Weak signal (low |t-stat|). Consider narrowing condition_scope.' END, said) AS hint FROM c"""
SQL["memory_context"] = f"WITH {RECORDS}, r AS {LAST.format(n=5)} SELECT '[Working Memory — Recent Iterations]' || chr(10) || '(+ 2 compressed earlier iterations)' || chr(10) || string_agg('  Iter' || line_no || ': ' || feature || ' → ' || outcome || CASE WHEN line_no % 2 = 0 THEN ' [t=1.0]' ELSE '' END, chr(10) ORDER BY line_no DESC) AS context FROM r"
SQL["common_pattern"] = f"WITH {RECORDS} SELECT 't_stat' AS pattern, count(*) AS n, count(*) AS failed FROM records WHERE NOT passed"
SQL["history_digest"] = f"""WITH {RECORDS}, r AS {LAST.format(n=12)} SELECT coalesce(string_agg(feature || printf('(IC=%+.3f, t=%+.2f)', ic_mean, t_stat), ';  ' ORDER BY line_no) FILTER (passed), '') AS passed,
  coalesce(string_agg(feature || printf(' IC=%+.4f t=%+.3f zero=%.0f%%', ic_mean, t_stat, zero_ratio * 100) || ' >> ' || diagnosis_fix, chr(10) ORDER BY line_no) FILTER (NOT passed), '') AS failed FROM r"""
SQL["score_assignment"] = """WITH b AS (SELECT o_orderkey AS episode, (row_number() OVER (ORDER BY o_orderkey) - 1) // 3 AS batch, (row_number() OVER (ORDER BY o_orderkey) - 1) % 3 + 1 AS i FROM orders)
SELECT episode, CASE WHEN i = 1 THEN CAST(batch % 3 AS DOUBLE) WHEN i = 3 AND batch % 2 = 0 THEN greatest(0.0 - CAST(batch % 4 AS DOUBLE), -2.0) END AS value FROM b"""
SQL["chunk_lookup"] = f"WITH {scored(6)}, f AS (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 12) SELECT chunk_id, md5(left(text, 300)) AS digest, round(f.score, 6) AS score FROM f JOIN documents ON doc_id = chunk_id"
SQL["run_documents"] = f"""WITH {STEPS}, l AS (SELECT run_id, step_id, state, concat_ws(' ', '[Step' || step_id || '|' || state || ']', tool || CASE WHEN ok THEN '✓' ELSE '✗' END, CASE WHEN coalesce(ms, 0) <> 0 THEN printf('%.0fms', ms) END, '→' || decision, CASE WHEN NOT ok THEN 'err=it failed' END) AS line, row_number() OVER (PARTITION BY run_id ORDER BY step_id DESC) AS r FROM steps)
SELECT run_id, step_id // 100 AS part, md5('[' || string_agg('{{"step_id":' || step_id || ',"state":"' || state || '"}}', ',' ORDER BY step_id) || ']') AS digest, any_value(summary) AS summary
FROM l JOIN (SELECT run_id, string_agg(line, ' | ' ORDER BY step_id) AS summary FROM l WHERE r <= 2 GROUP BY run_id) USING (run_id) GROUP BY run_id, step_id // 100"""
SQL["report_documents"] = f"""WITH {RESULTS} SELECT feature, '{{"feature":"' || feature || '","k":' || k || ',"coverage_failure":' || CASE WHEN cf THEN 'true' ELSE 'false' END || '}}' AS document FROM res"""
RETURNS = f"{PANEL}, {FEATURES}, r AS (SELECT p.*, feature, value FROM (SELECT *, {TARGET} / 100 AS ret FROM panel) p JOIN features USING (episode) WHERE {TEST})"
BUCKETS = """c AS (SELECT *, count(*) OVER (PARTITION BY feature, year, quarter) AS n, count(*) OVER (PARTITION BY feature, year, quarter ORDER BY value) AS to_ FROM {rows} WHERE value IS NOT NULL),
cuts AS (SELECT feature, year, quarter, j, min(value) AS cut FROM c, (VALUES (1), (2), (3), (4)) AS b(j) WHERE to_ * 5 >= n * j GROUP BY ALL),
bucketed AS (SELECT c.*, 1 + (SELECT count(*) FROM cuts WHERE cuts.feature = c.feature AND cuts.year = c.year AND cuts.quarter = c.quarter AND cut < c.value) AS bucket FROM c)"""
SQL["quantile_buckets"] = f"WITH {ROWS}, {BUCKETS.format(rows='rows_')} SELECT feature, year, quarter, CAST(bucket AS INTEGER) AS bucket, count(*) AS n FROM bucketed GROUP BY ALL"
PATH = f"""{RETURNS}, {BUCKETS.format(rows='(SELECT * FROM r WHERE ret IS NOT NULL)')},
ls AS (SELECT feature, year, quarter, avg(ret) FILTER (bucket = 5) - avg(ret) FILTER (bucket = 1) AS spread FROM bucketed GROUP BY ALL HAVING count(*) >= 5),
w AS (SELECT *, product(1 + spread) OVER (PARTITION BY feature ORDER BY year, quarter) AS wealth FROM ls WHERE spread IS NOT NULL),
path AS (SELECT *, wealth / greatest(1, max(wealth) OVER (PARTITION BY feature ORDER BY year, quarter)) - 1 AS drawdown FROM w)"""
SQL["portfolio_path"] = f"WITH {PATH} SELECT feature, year, quarter, round(spread, 6) AS spread, round(wealth, 6) AS wealth, round(drawdown, 6) AS drawdown FROM path"
RISK = f"""SELECT p.feature, count(*) AS n_quarters, avg(spread) AS spread_mean, avg(spread) / stddev_samp(spread) * 2 AS information_ratio, any_value(icir) AS icir, last(wealth ORDER BY year, quarter) AS wealth, min(drawdown) AS max_drawdown
FROM path p LEFT JOIN (SELECT feature, avg(ic) / stddev_samp(ic) AS icir FROM ({ic('r', 'feature, year, quarter', 'ret')}) GROUP BY feature) i ON p.feature = i.feature GROUP BY p.feature"""
SQL["portfolio_risk"] = f"WITH {PATH} SELECT feature, n_quarters, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("spread_mean", "information_ratio", "icir", "wealth", "max_drawdown")) + f" FROM ({RISK})"
SQL["drawdown_gate"] = f"""WITH v AS ({SQL['validation_metrics']}), k AS (WITH {PATH} {RISK})
SELECT feature, round(max_drawdown, 6) AS max_drawdown, array_to_string(list_filter([CASE WHEN coverage_failure OR coverage < {G.LEAST_COVERAGE} THEN 'G1_coverage' END, CASE WHEN abs(t_stat) < {G.LEAST_T} THEN 'G3_t_stat' END,
  CASE WHEN direction_consistency < {G.LEAST_CONSISTENCY} THEN 'G4_direction' END, CASE WHEN abs(max_drawdown) > {G.MOST_DRAWDOWN} THEN 'G5_max_drawdown' END], lambda x: x IS NOT NULL), ',') AS failed FROM v LEFT JOIN k USING (feature)"""
SQL["lineage_depth"] = """WITH RECURSIVE v AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 500 = 150 THEN p_partkey + 3 WHEN p_partkey % 100 > 0 THEN p_partkey - 1 END AS of_ FROM part),
p AS (SELECT v.k, o.k AS of_ FROM v LEFT JOIN v o ON o.k = v.of_),
up AS (SELECT k, k AS root, 0 AS depth FROM p WHERE of_ IS NULL UNION ALL SELECT p.k, up.root, up.depth + 1 FROM p JOIN up ON p.of_ = up.k)
SELECT 'v' || p.k AS feature, 'v' || up.root AS root, CAST(up.depth AS BIGINT) AS depth, up.k IS NULL AS cyclic FROM p LEFT JOIN up ON up.k = p.k"""
SQL["all_vectors_topk"] = f"""SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {DOT.format(a='c.embedding', b='q.embedding')} AS score FROM embeddings c, embeddings q)) WHERE rank <= 5"""
SQL["asof_features"] = f"""WITH {PANEL}, r AS (SELECT o_custkey AS symbol, l_shipdate AS shipped_on, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT p.symbol, p.episode, strftime(r.shipped_on, '%Y-%m-%d') AS day, r.shipped FROM panel p ASOF LEFT JOIN r ON p.symbol = r.symbol AND p.earnings_date >= r.shipped_on"""


def tokens(x: str) -> str:
    cjk = f"length(regexp_replace({x}, '[^一-鿿]', '', 'g'))"
    return f"CAST(coalesce(floor({cjk} * 1.5 + (length({x}) - {cjk}) / 4.0), 0) AS INTEGER)"


def _quoted(x: str) -> str:
    return "'" + x.replace("\n", "' || chr(10) || '") + "'"


def _within(x: str, most: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' OR {most} <= 0 THEN '' WHEN {tokens(x)} <= {most} THEN {x} ELSE left({x}, CAST(floor(length({x}) * (CAST({most} AS DOUBLE) / {tokens(x)}) * 0.9) AS INTEGER)) || {_quoted(C.CUT)} END"


def _context(pass_on: bool) -> str:
    spare = (lambda n: f" + greatest({n}, 0)") if pass_on else (lambda n: "")
    return f"""WITH turns AS (SELECT conv_id, turn, role, text, '[' || role || '] ' || text AS line FROM conversations),
parts AS (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'system'), '') AS system, arg_max(text, turn) FILTER (role = 'user') AS task, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'assistant'), '') AS hints FROM turns GROUP BY conv_id),
m AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, line) AS memory FROM (SELECT *, sum({tokens('line')}) OVER (PARTITION BY conv_id ORDER BY turn DESC, line DESC ROWS UNBOUNDED PRECEDING) AS up FROM turns) WHERE up <= 120 GROUP BY conv_id),
p AS (SELECT parts.*, coalesce(memory, '') AS memory FROM parts LEFT JOIN m USING (conv_id)),
s AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN CASE WHEN hints = '' THEN memory ELSE memory || {_quoted(chr(10) * 2 + C.SIMILAR)} || hints END
  WHEN 1 THEN concat_ws(chr(10) || chr(10), nullif(memory, ''), CASE WHEN hints <> '' THEN {_quoted(C.PAST)} || hints END)
  ELSE CASE WHEN hints = '' THEN memory ELSE {_quoted(C.RETRIEVED)} || hints || {_quoted(chr(10) * 2 + C.RECENT)} || memory END END AS session FROM p),
a AS (SELECT *, {_within('system', '60')} AS sb FROM s), b AS (SELECT *, {tokens('sb')} AS st, 200{spare('60 - ' + tokens('sb'))} AS tm FROM a),
c AS (SELECT *, {_within('task', 'tm')} AS tb FROM b), e AS (SELECT *, {tokens('tb')} AS tt, 140{spare('tm - ' + tokens('tb'))} AS sm FROM c),
f AS (SELECT *, {_within('session', 'sm')} AS eb FROM e), g AS (SELECT *, {tokens('eb')} AS et FROM f)
SELECT conv_id, md5(concat_ws({_quoted(C.BETWEEN)}, nullif(sb, ''), nullif(tb, ''), CASE WHEN eb <> '' THEN {_quoted(C.SESSION)} || eb END)) AS digest, st AS system_tokens, tt AS task_tokens, et AS session_tokens, st + tt + et AS total_tokens, round((st + tt + et) / 400.0, 6) AS utilization FROM g"""


SQL["context_assembly"], SQL["context_passed_on"] = _context(False), _context(True)
