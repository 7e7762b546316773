"""Queries of the chart data and of the small tables that texts are made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import funnel, report
from ..sources import adapter, shared
from .catalog import AS_OF, _AREA, _CANDS, _CI, _FUNNEL, _GRID, _LEVEL, _PAREA, _PERIODS, _REBUCKET, PERIODS, _loa_sql, _rounded, _transition_sql, cands, funnels, margins, query

_STEP = "CASE from_phase WHEN 'Phase 1' THEN 'P1→P2' WHEN 'Phase 2' THEN 'P2→P3' WHEN 'Phase 3' THEN 'P3→Appr' ELSE 'Appr→Mkt' END"
_CROSS = f"""{_REBUCKET}, cross0 AS (SELECT modality, {_AREA.format('disease_area')} AS area, from_phase, sum(numerator)::BIGINT AS numerator, sum(denominator)::BIGINT AS denominator FROM funnel WHERE stratum = 'modality_disease_area' GROUP BY ALL),
    views AS (SELECT 'All' AS view, modality, from_phase, numerator, denominator FROM funnel WHERE stratum = 'modality' UNION ALL SELECT area, modality, from_phase, numerator, denominator FROM cross0),
    cells AS (SELECT *, numerator / denominator::DOUBLE AS rate FROM views WHERE denominator > 0), {_CI.format('cells')}"""


@query("g9_bubbles", f"""{_CROSS}, b AS (SELECT view, modality, {_GRID}, {_STEP} AS step, greatest(0.0, centre - half) AS lo, least(1.0, centre + half) AS hi FROM ci)
    SELECT view, modality, from_phase, denominator, round(greatest(8.0, least(60.0, sqrt(denominator) * 5)), 9) AS size, modality || ' | ' || step || ', rate ' || format('{{:.1f}}%', rate * 100) || ', ' || numerator || ' of ' || denominator || ', 95 % interval ' || format('{{:.1f}}%', lo * 100) || ' to ' || format('{{:.1f}}%', hi * 100) AS hover FROM b""")
def g9(spark: SparkSession, d: str) -> DataFrame:
    rows = report.bubble_views(report.displayed(shared.kept(funnels(spark, d))), "modality", "disease_area")  # three views of few rows
    return _rounded(rows, "size").select("view", "modality", "from_phase", "denominator", "size", "hover")


@query("g10_spider", f"""{_FUNNEL}, s AS (SELECT coalesce(disease_area, 'Overall') AS label, CASE WHEN stratum = 'overall' THEN 'overall_spider' ELSE 'disease_spider_' || replace(replace(lower(disease_area), ' ', '_'), '/', '_') END AS key, from_phase, rate,
    max(CASE WHEN from_phase = 'Phase 1' THEN denominator END) OVER (PARTITION BY stratum, disease_area) AS n FROM funnel WHERE stratum = 'overall' OR stratum = 'disease_area' AND candidate_count > 20) SELECT * FROM s""")
def g10(spark: SparkSession, d: str) -> DataFrame:
    return report.spiders(funnels(spark, d))


_SIDES = f"""{_FUNNEL}, sides AS (SELECT side, from_phase, numerator, denominator, numerator / denominator::DOUBLE AS rate FROM (
    SELECT CASE WHEN disease_area = 'oncology' THEN 'Oncology' ELSE 'Non-Oncology' END AS side, from_phase, sum(numerator)::BIGINT AS numerator, sum(denominator)::BIGINT AS denominator FROM funnel WHERE stratum = 'disease_area' GROUP BY ALL))"""


@query("g11_oncology_chart", f"{_SIDES} SELECT side, from_phase AS step, round(rate * 100, 9) AS pct, denominator AS n FROM sides UNION ALL SELECT side, 'LOA', round(loa_1 * 100, 9), n_1 + n_2 + n_3 + n_4 FROM {_loa_sql('sides', 'side')}")
def g11(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(report.oncology_chart(funnel.oncology(margins(spark, d))), "pct")


_SHARES = f"{_CANDS}, y AS (SELECT year(earliest_start)::INT AS year, modality, count(*) AS n FROM cands GROUP BY ALL), sh AS (SELECT year, modality, n, n / sum(n) OVER (PARTITION BY year)::DOUBLE AS share FROM y)"


@query("g12_trend_chart", f"""{_SHARES}, t AS (SELECT year, sum(n) AS total FROM sh GROUP BY 1), k AS (SELECT year FROM t WHERE total >= 10 OR (SELECT max(total) FROM t) < 10)
    SELECT k.year, m.modality, round(coalesce(sh.share, 0.0) * 100, 9) AS pct, CASE WHEN (SELECT count(*) FROM k) >= 4 THEN 'area' ELSE 'bars' END AS kind FROM k CROSS JOIN (SELECT DISTINCT modality FROM sh) m LEFT JOIN sh ON sh.year = k.year AND sh.modality = m.modality""")
def g12(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(report.trend_chart(report.modality_shares(cands(spark, d))), "pct")


@query("g15_share_changes", f"""{_SHARES}, e AS (SELECT modality, coalesce(max(share) FILTER (year = (SELECT min(year) FROM sh)), 0.0) AS first_share, coalesce(max(share) FILTER (year = (SELECT max(year) FROM sh)), 0.0) AS last_share FROM sh GROUP BY 1)
    SELECT modality, first_share, last_share, round(last_share - first_share, 9) AS change FROM e WHERE abs(last_share - first_share) > 0.005""")
def g15_changes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(report.share_changes(report.modality_shares(cands(spark, d)), 0.005), "change")


@query("g14_count_bars", f"{_FUNNEL} SELECT DISTINCT modality, candidate_count FROM funnel WHERE stratum = 'modality' ORDER BY candidate_count DESC, modality")
def g14(spark: SparkSession, d: str) -> DataFrame:
    return report.count_bars(funnels(spark, d), "modality")


_EACH = f"{_CANDS}, {_PERIODS}, {_PAREA}, tr AS ({_transition_sql('parea', 'area, period')}), each_ AS (SELECT area, period, loa_1 AS loa, n_1 + n_2 + n_3 + n_4 AS n FROM {_loa_sql('tr', 'area, period')})"


@query("a35_weighted_loa", f"{_EACH} SELECT period, round(sum(loa * n) / sum(n), 9) AS loa FROM each_ WHERE n > 0 GROUP BY period")
def a35_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(report.weighted_loa(report.period_area_loa(cands(spark, d), PERIODS)), "loa")


@query("a35_movers", f"""{_EACH}, m AS (SELECT a.area, a.loa AS loa_first, b.loa AS loa_last, (b.loa - a.loa) / a.loa AS change FROM each_ a JOIN each_ b ON a.area = b.area AND a.period = '1995–1997' AND b.period = '1998–2001' WHERE a.loa > 0),
    k AS (SELECT *, CASE WHEN change > 0.1 THEN 'improvement' WHEN change < -0.1 THEN 'decline' END AS kind FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY change DESC, area) AS at_ FROM k WHERE kind IS NOT NULL)
    SELECT kind, at_::INT AS place, area, round(loa_first, 9) AS loa_first, round(loa_last, 9) AS loa_last, round(change, 9) AS change FROM r WHERE at_ <= 3""")
def a35(spark: SparkSession, d: str) -> DataFrame:
    rows = report.movers(report.period_area_loa(cands(spark, d), PERIODS), "1995–1997", "1998–2001")
    return _rounded(rows, "loa_first", "loa_last", "change").select("kind", F.col("at").alias("place"), "area", "loa_first", "loa_last", "change")


@query("a36_extremes", f"""{_REBUCKET}, s AS (SELECT area, from_phase, avg_duration_years AS y, sum(avg_duration_years) OVER (PARTITION BY area) AS whole FROM re2),
    r AS (SELECT *, row_number() OVER (PARTITION BY from_phase ORDER BY y, whole, area) AS s, row_number() OVER (PARTITION BY from_phase ORDER BY y DESC, whole, area) AS l FROM s WHERE y IS NOT NULL)
    SELECT a.from_phase, a.area AS shortest, round(a.y, 9) AS shortest_years, b.area AS longest, round(b.y, 9) AS longest_years FROM r a JOIN r b ON a.from_phase = b.from_phase AND a.s = 1 AND b.l = 1""")
def a36(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(report.extremes(funnel.rebucketed(margins(spark, d)), "area"), "shortest_years", "longest_years")


@query("g3_default_periods", f"""{_CANDS}, y AS (SELECT year(earliest_start) AS year FROM cands WHERE earliest_start IS NOT NULL), c AS (SELECT list_sort(list(year)) AS ys FROM y),
    p AS (SELECT ys[1] AS first, ys[-1] AS last, CASE WHEN 2001 - 9 <= ys[1] THEN ys[len(ys) // 2 + 1] + 1 ELSE 2001 - 9 END AS cut FROM c)
    SELECT first || '–' || (cut - 1) AS period, count(*) FILTER (year < cut) AS n FROM p, y GROUP BY ALL UNION ALL SELECT cut || '–' || last, count(*) FILTER (year >= cut) FROM p, y GROUP BY ALL""")
def g3_default(spark: SparkSession, d: str) -> DataFrame:
    rows = shared.kept(cands(spark, d).select("earliest_start"))  # the years are counted before their periods are known
    counts = {r["year"]: r["n"] for r in report.start_years(rows).where("year IS NOT NULL").collect()}  # a row for each year
    return report.periods(rows, report.default_periods(counts, AS_OF)).groupBy("period").agg(F.count("*").alias("n"))


@query("o29_period_areas", f"{_EACH} SELECT area, count(DISTINCT period) = 2 AS in_both FROM each_ GROUP BY area")
def o29(spark: SparkSession, d: str) -> DataFrame:
    """Areas of either period (distinct union), and whether both have them (intersection)."""
    return report.in_periods(report.period_area_loa(cands(spark, d), PERIODS), PERIODS)


@query("a13_period_cube", f"""{_CANDS}, {_PERIODS}, z AS (SELECT period, CASE WHEN coalesce(disease_area, '') <> '' THEN {_AREA.format('disease_area')} END AS area, coalesce(outcome NOT IN ('Ongoing', 'Unknown'), false) AS known, {_LEVEL} AS level FROM periods),
    u AS (SELECT grouping(period, area) AS id, period, area, count(*) AS candidate_count, {', '.join(f"count(*) FILTER (known AND level >= {i}) AS c{i}" for i in range(5))} FROM z GROUP BY GROUPING SETS ((period, area), (period), (area), ()))
    SELECT CASE id WHEN 0 THEN 'cell' WHEN 1 THEN 'period' WHEN 2 THEN 'area' ELSE 'all' END AS grain, period, area, candidate_count, c0, c1, c2, c3, c4,
        round({' * '.join(f"CASE WHEN c{i} > 0 THEN c{i + 1} / c{i}::DOUBLE ELSE 0.0 END" for i in range(4))}, 9) AS loa, c0 + c1 + c2 + c3 AS n FROM u WHERE area IS NOT NULL OR id IN (1, 3)""")
def a13_cube(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(report.period_cube(cands(spark, d), PERIODS), "loa")


_WORDS = "CASE WHEN {b} = 0 THEN 'infinitely higher than' WHEN {a} / {b} >= 2.5 THEN format('{{:.0f}}-fold higher than', {a} / {b}) WHEN {a} / {b} >= 1.8 THEN 'nearly ' || round({a} / {b})::INT || '-fold higher than' WHEN {a} / {b} >= 1.3 THEN 'substantially higher than' WHEN {a} / {b} >= 1.05 THEN 'slightly higher than' WHEN {a} / {b} >= 0.95 THEN 'comparable to' WHEN {a} / {b} >= 0.7 THEN 'slightly lower than' ELSE 'substantially lower than' END"


@query("p25_words", f"""WITH p AS (SELECT p_partkey, p_size, p_retailprice / 1234.5 AS share, (p_partkey % 9)::DOUBLE AS b FROM part) SELECT p_partkey, format('{{:.1f}}%', share * 100) AS pct, {_WORDS.format(a="p_size", b="b").replace("{{", "{").replace("}}", "}")} AS fold FROM p""", False)
def p25(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.table(spark, d, "part").withColumns({"share": F.col("p_retailprice") / F.lit(1234.5), "b": (F.col("p_partkey") % 9).cast("double")})
    return rows.select("p_partkey", text.pct(F.col("share")).alias("pct"), text.fold(F.col("p_size").cast("double"), F.col("b")).alias("fold"))


@query("p32_slug", "SELECT p_partkey, replace(replace(lower(p_brand || '/' || p_name), ' ', '_'), '/', '_') AS slug FROM part", False)
def p32(spark: SparkSession, d: str) -> DataFrame:
    return adapter.table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws("/", "p_brand", "p_name")).alias("slug"))
