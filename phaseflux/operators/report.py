"""Report tables from candidates and the funnel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text, vocab
from . import funnel

STEPS = vocab.STAGES[:-1]
#: Candidates that an area must exceed for a spider chart, candidates of a year and denominators of a stratum at least for a chart.
SPIDER, YEAR, LEAST = 20, 10, 10


def grid(rows: DataFrame, by: str, drop_empty: bool, *keep: str) -> DataFrame:
    """Rate with a 95 % interval per row and transition; a rate is null and its interval (0, 0) for none of none."""
    n = F.col("denominator")
    low, high = stats.wilson(F.col("numerator"), n)
    out = rows.select(*keep, by, "from_phase", "numerator", "denominator", F.when(n > 0, F.col("rate")).alias("rate"), F.coalesce(low, F.lit(0.0)).alias("ci_low"), F.coalesce(high, F.lit(0.0)).alias("ci_high"))
    if drop_empty:
        whole = Window.partitionBy(*keep, by)
        out = out.withColumn("_all", F.sum("denominator").over(whole)).where("_all > 0").drop("_all")
    return out


def _percent(c: str) -> Column:
    return F.format_string("%.1f%%", F.col(c) * 100)


def bubbles(cells: DataFrame, by: str) -> DataFrame:
    """Markers of a grid's cells that have any denominator: size and hover text."""
    size = F.greatest(F.lit(8.0), F.least(F.lit(60.0), F.sqrt("denominator") * 5))
    step = vocab.lookup(F.col("from_phase"), vocab.STEP_LABELS)
    hover = F.concat(F.col(by), F.lit(" | "), step, F.lit(", rate "), _percent("rate"), F.format_string(", %d of %d, 95 %% interval ", "numerator", "denominator"), _percent("ci_low"), F.lit(" to "), _percent("ci_high"))
    return cells.where("denominator > 0").withColumns({"size": size, "hover": hover})


def bubble_views(rows: DataFrame, by: str, other: str) -> DataFrame:
    """Bubbles by modality or area: a view of all, and one for each value of the other; `rows` is the funnel in display areas."""
    every = rows.where(F.col("stratum") == by).withColumn("view", F.lit("All"))
    each = rows.where(F.col("stratum") == "modality_disease_area").withColumn("view", F.col(other))
    return bubbles(grid(every.unionByName(each), by, by == "disease_area", "view"), by)


def displayed(rows: DataFrame) -> DataFrame:
    """The funnel with its areas, and the pairs, in display areas; other strata stay as they are."""
    areas = rows.where(F.col("stratum").isin("disease_area", "modality_disease_area"))
    plain = rows.where(F.col("stratum").isin("overall", "modality")).drop("n_durations")
    return plain.unionByName(funnel.rebucketed(areas, "disease_area", "area", ("stratum", "modality")).withColumnRenamed("area", "disease_area"))


def periods(cands: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Candidates with the period of their start year; ranges are inclusive, a candidate without a start is in none."""
    dim = cands.sparkSession.createDataFrame([(f"{a}–{b}", a, b) for a, b in ranges], "period string, low int, high int")
    return cands.where("earliest_start IS NOT NULL").withColumn("year", F.year("earliest_start")).join(F.broadcast(dim), F.col("year").between(F.col("low"), F.col("high"))).drop("low", "high")


def start_years(cands: DataFrame) -> DataFrame:
    """Candidates by start year; a null year counts those that no period has."""
    return cands.groupBy(F.year("earliest_start").alias("year")).agg(F.count("*").alias("n"))


def default_periods(counts: dict[int, int], today: dt.date) -> list[tuple[int, int]]:
    """The last ten years, this one included, against those before; if all years are in them, two halves at the upper median year."""
    years = sorted(counts)
    if not years:
        return []
    cut = today.year - 9
    if cut <= years[0]:
        at, cut = sum(counts.values()) // 2, years[0]
        for year in years:
            if at < counts[year]:
                cut = year + 1
                break
            at -= counts[year]
    return [(years[0], cut - 1), (cut, years[-1])]


def period_cube(cands: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Candidates of periods by display area: (grain, period, area, candidate_count, c0..c4, loa, n), from one aggregate.

    grain is `cell` for a period's area, `period`, `area` or `all`, with nulls for what it sums over; c0..c4 count the resolved
    candidates that came as far, loa is the likelihood of approval from phase 1, n the sum of denominators. A candidate without an
    area counts in `period` and `all` only. Every table of periods and areas reads this, and so the candidates once.
    """
    area = F.when(F.coalesce("disease_area", F.lit("")) != "", text.display_area(F.col("disease_area")))
    rows = periods(cands, ranges).select("period", area.alias("area"), funnel.resolved(False).alias("known"), funnel.level().alias("level"))
    reached = [F.sum((F.col("known") & (F.col("level") >= i)).cast("long")).alias(f"c{i}") for i in range(5)]
    sets = [[F.col("period"), F.col("area")], [F.col("period")], [F.col("area")], []]
    sums = rows.groupingSets(sets, F.col("period"), F.col("area")).agg(F.grouping_id().alias("id"), F.count("*").alias("candidate_count"), *reached)
    grain = F.when(F.col("id") == 0, "cell").when(F.col("id") == 1, "period").when(F.col("id") == 2, "area").otherwise("all")
    rate = F.lit(1.0)
    for i in range(3, -1, -1):
        rate = stats.ratio(F.col(f"c{i + 1}"), F.col(f"c{i}")) * rate
    counts = [f"c{i}" for i in range(5)]
    full = sums.where("area IS NOT NULL OR id IN (1, 3)").withColumn("grain", grain)  # the sum over a missing area is no area
    return full.select("grain", "period", "area", "candidate_count", *counts, rate.alias("loa"), F.expr("c0 + c1 + c2 + c3").alias("n"))


def period_area_loa(cands: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """(area, period, loa, n) of the cube's cells: likelihood of approval from phase 1 and the sum of denominators; without an area a candidate is in none."""
    return period_cube(cands, ranges).where("grain = 'cell'").select("area", "period", "loa", "n")


def in_periods(each: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Areas of any period (a distinct union), and whether all periods have them (an intersection), by one count for each area."""
    return each.groupBy("area").agg((F.count_distinct("period") == len(ranges)).alias("in_both"))


def period_loa(cands: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Per area a likelihood of approval and a sum of denominators for each period; a missing period is null with 0."""
    each = period_area_loa(cands, ranges)
    at = lambda c, a, b: F.max(F.when(F.col("period") == f"{a}–{b}", F.col(c)))
    return each.groupBy("area").agg(*(at("loa", a, b).alias(f"loa_{a}-{b}") for a, b in ranges), *(F.coalesce(at("n", a, b), F.lit(0)).alias(f"n_{a}-{b}") for a, b in ranges))


def weighted_loa(each: DataFrame) -> DataFrame:
    """Each period's mean likelihood over its areas, weighted by n."""
    return each.where("n > 0").groupBy("period").agg((F.sum(F.col("loa") * F.col("n")) / F.sum("n")).alias("loa"))


def movers(each: DataFrame, first: str, last: str, n: int = 3) -> DataFrame:
    """Areas of both periods whose likelihood rose or fell by more than a tenth: of each kind the first `n` by change."""
    at = lambda period, name: F.max(F.when(F.col("period") == period, F.col("loa"))).alias(name)
    rows = each.groupBy("area").agg(at(first, "loa_first"), at(last, "loa_last")).where("loa_first > 0 AND loa_last IS NOT NULL").withColumn("change", (F.col("loa_last") - F.col("loa_first")) / F.col("loa_first"))
    rows = rows.withColumn("kind", F.when(F.col("change") > 0.1, "improvement").when(F.col("change") < -0.1, "decline")).where("kind IS NOT NULL")
    turn = Window.partitionBy("kind").orderBy(F.desc("change"), "area")  # a row for each area at most
    return rows.withColumn("at", F.row_number().over(turn)).where(F.col("at") <= n)


def sponsors(cands: DataFrame) -> DataFrame:
    """Candidates, modalities and areas of each sponsor."""
    rows = cands.select(F.explode("sponsors").alias("sponsor"), "modality", "disease_area")
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ", ")
    return rows.groupBy("sponsor").agg(F.count("*").alias("n_candidates"), F.size(F.collect_set("modality")).cast("long").alias("n_modalities"), names("modality").alias("modalities"), F.size(F.collect_set("disease_area")).cast("long").alias("n_areas"), names("disease_area").alias("areas"))


def sponsor_summary(cands: DataFrame) -> DataFrame:
    """Uniques, single-candidate sponsors, the top ten's share (may exceed 100) and the median."""
    counts = cands.select(F.explode("sponsors").alias("sponsor")).groupBy("sponsor").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n")).limit(10).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top"))
    sums = counts.agg(F.count("*").alias("uniques"), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)).alias("singles"), F.coalesce(F.median("n"), F.lit(0.0)).alias("median"))
    total = cands.agg(F.count("*").alias("total"))
    # three one-row frames side by side
    out = sums.join(top, F.lit(True)).join(total, F.lit(True))
    return out.select("uniques", "singles", (stats.ratio(F.col("singles"), F.col("uniques")) * 100).alias("singles_pct"), (stats.ratio(F.col("top"), F.col("total")) * 100).alias("top10_pct"), "median")


def sponsor_bins(table: DataFrame) -> DataFrame:
    """Sponsors by their number of candidates: fixed edges if one has over 50, else a bin per number."""
    n, edge = F.col("n_candidates"), F.lit(1)
    for e in (2, 5, 10, 25, 50, 100):
        edge = F.when(n >= e, F.lit(e)).otherwise(edge)
    rows = table.select("n_candidates").join(table.agg(F.max("n_candidates").alias("most")), F.lit(True))  # one row on the right
    return rows.groupBy(F.when(F.col("most") > 50, edge).otherwise(n.cast("int")).alias("bin")).agg(F.count("*").alias("n_sponsors"))


def modality_shares(cands: DataFrame) -> DataFrame:
    """Share of each modality among the candidates that start in a year."""
    rows = cands.where("earliest_start IS NOT NULL AND modality IS NOT NULL").groupBy(F.year("earliest_start").alias("year"), "modality").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("year"))
    return rows.select("year", "modality", "n", (F.col("n") / total).alias("share"))


def trend_chart(shares: DataFrame) -> DataFrame:
    """(year, modality, pct, kind): shares of every modality in every year with enough candidates, or in every year if none has.

    Missing shares are 0; kind is area from four years on, else bars. A table of years, so its windows are small.
    """
    years = shares.groupBy("year").agg(F.sum("n").alias("total"))
    every = years.agg((F.max("total") >= YEAR).alias("some"), F.sum((F.col("total") >= YEAR).cast("long")).alias("enough"), F.count("*").alias("all"))
    shown = years.join(every, F.lit(True)).where(~F.col("some") | (F.col("total") >= YEAR))
    kind = F.when(F.when(F.col("some"), F.col("enough")).otherwise(F.col("all")) >= 4, "area").otherwise("bars")
    frame = shown.select("year", kind.alias("kind")).join(shares.select("modality").distinct(), F.lit(True))
    return frame.join(shares, ["year", "modality"], "left").select("year", "modality", (F.coalesce("share", F.lit(0.0)) * 100).alias("pct"), "kind")


def share_changes(shares: DataFrame, least: float = 0.03) -> DataFrame:
    """Modalities whose share differs by more than `least` between the first and the last year."""
    ends = shares.agg(F.min("year").alias("first"), F.max("year").alias("last"))
    at = lambda y: F.coalesce(F.max(F.when(F.col("year") == F.col(y), F.col("share"))), F.lit(0.0))
    rows = shares.join(ends, F.lit(True)).groupBy("modality").agg(at("first").alias("first_share"), at("last").alias("last_share"))
    return rows.withColumn("change", F.col("last_share") - F.col("first_share")).where(F.abs("change") > least)


def best_p(trials: DataFrame, key: str) -> DataFrame:
    """Least p-value per candidate and phase, of single-arm trials (`is_single_arm`)."""
    return trials.where("is_single_arm AND p_value IS NOT NULL AND phase IS NOT NULL").groupBy(key, "phase").agg(F.min("p_value").alias("best_p"))


def inconsistent(outcome: Column, p: dict[int, Column], has_p: Column) -> Column:
    """Whether an outcome contradicts the p-values of its phase; null without any p-value, whatever its phase."""
    hit = outcome.isin("Approved", "Commercialized") & (p[3] > 0.05)
    for i in (1, 2, 3):
        hit = F.coalesce(hit, F.lit(False)) | F.coalesce((outcome == f"Failed Phase {i}") & (p[i] <= 0.05), F.lit(False))
    return F.when(F.coalesce(has_p, F.lit(False)), hit)


def milestone(dates: list[str], as_of: dt.date) -> Column:
    """The latest of some dates strictly before a day."""
    return F.array_max(F.filter(F.array(*dates), lambda d: d < F.lit(as_of)))


def summary(cands: DataFrame, as_of: dt.date, modality: str | None = None) -> DataFrame:
    """One row per candidate with its milestone and whether its p-values contradict its outcome; optionally of one modality.

    The least p-values by phase come with the candidates, so nothing is joined.
    """
    rows = cands.where(F.col("modality") == modality) if modality else cands
    flag = inconsistent(F.col("outcome"), {i: F.col(f"p_{i}") for i in (1, 2, 3)}, F.col("has_p"))
    return rows.select(
        "candidate_id", "drug_name", "indication", "highest_phase", "modality", "disease_area", "outcome", milestone(["latest_completion", "approval_date", "market_date"], as_of).alias("latest_milestone_date"), flag.alias("p_value_inconsistent")
    )


def loa_chart(table: DataFrame, least: int = LEAST) -> DataFrame:
    """Strata with enough denominators, by likelihood of approval."""
    return table.where(F.expr("n_1 + n_2 + n_3 + n_4") >= least).orderBy("loa_1", *[c for c in table.columns if not c.startswith(("loa", "n_"))])


def phase_success(rows: DataFrame, by: str, phase: str) -> DataFrame:
    """Strata with a denominator in one transition, by rate."""
    return rows.where((F.col("from_phase") == phase) & (F.col("denominator") > 0)).orderBy("rate", by).select(by, "rate", "denominator")


def spiders(rows: DataFrame) -> DataFrame:
    """(label, key, from_phase, rate, n) of the charts: overall, and each area with more than SPIDER candidates; n is phase 1's denominator."""
    shown = rows.where((F.col("stratum") == "overall") | (F.col("stratum") == "disease_area") & (F.col("candidate_count") > SPIDER))
    label = F.coalesce("disease_area", F.lit("Overall"))
    key = F.when(F.col("stratum") == "overall", "overall_spider").otherwise(F.concat(F.lit("disease_spider_"), text.slug(label)))
    n = F.max(F.when(F.col("from_phase") == "Phase 1", F.col("denominator"))).over(Window.partitionBy("stratum", "disease_area"))
    return shown.select(label.alias("label"), key.alias("key"), "from_phase", "rate", n.alias("n"))


def oncology_chart(sides: DataFrame) -> DataFrame:
    """(side, step, pct, n): the rates of both sides, and their likelihood of approval with all denominators."""
    steps = sides.select("side", F.col("from_phase").alias("step"), (F.col("rate") * 100).alias("pct"), F.col("denominator").alias("n"))
    whole = funnel.loa(sides, ["side"]).select("side", F.lit("LOA").alias("step"), (F.col("loa_1") * 100).alias("pct"), F.expr("n_1 + n_2 + n_3 + n_4").alias("n"))
    return steps.unionByName(whole)


def count_bars(rows: DataFrame, by: str) -> DataFrame:
    """Candidates of each stratum, the most first."""
    return rows.where(F.col("stratum") == by).groupBy(by).agg(F.max("candidate_count").alias("candidate_count")).orderBy(F.desc("candidate_count"), by)


def timeline(rows: DataFrame, by: str) -> DataFrame:
    """(by, from_phase, years, offset, total): mean years with running offsets, shortest total of the clinical phases first.

    A missing duration counts 0; a row without any is left out. `rows` is the funnel of one margin.
    """
    place = vocab.lookup(F.col("from_phase"), vocab.FUNNEL_LEVEL)
    span, whole = F.coalesce("avg_duration_years", F.lit(0.0)), Window.partitionBy(by)
    before = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    full = rows.withColumns({"place": place, "years": span, "some": F.count("avg_duration_years").over(whole)}).where("some > 0")
    total = F.sum(F.when(F.col("place") < 3, F.col("years"))).over(whole)
    return full.select(by, "from_phase", "years", F.coalesce(F.sum("years").over(before), F.lit(0.0)).alias("offset"), total.alias("total")).orderBy("total", by, "offset")


def extremes(rows: DataFrame, by: str) -> DataFrame:
    """Per phase the strata with the shortest and the longest mean duration; of equals the one with the shorter whole, then by name."""
    whole = F.sum("avg_duration_years").over(Window.partitionBy(by))
    some = rows.withColumn("whole", whole).where("avg_duration_years IS NOT NULL")
    y = F.col("avg_duration_years")
    pick = lambda sign: F.min_by(F.struct(F.col(by).alias("name"), y.alias("years")), F.struct(sign * y, "whole", by))
    out = some.groupBy("from_phase").agg(pick(1).alias("s"), pick(-1).alias("l"))
    return out.select("from_phase", F.col("s.name").alias("shortest"), F.col("s.years").alias("shortest_years"), F.col("l.name").alias("longest"), F.col("l.years").alias("longest_years"))


def metadata(cands: DataFrame, overall: DataFrame) -> DataFrame:
    """Transitions, candidates, distinct sponsors, first and last start year; `overall` is the funnel's."""
    t = overall.agg(F.coalesce(F.sum("denominator"), F.lit(0)).alias("transitions"))
    n = cands.agg(F.count("*").alias("n_candidates"), F.min(F.year("earliest_start")).alias("first_year"), F.max(F.year("earliest_start")).alias("last_year"))
    s = cands.select(F.explode("sponsors").alias("sponsor")).agg(F.count_distinct("sponsor").alias("n_sponsors"))
    return t.join(n, F.lit(True)).join(s, F.lit(True))  # one row each
