"""Phase-transition funnel in long form: a row per stratum and transition.

Candidates contribute their level, trials their duration. Both become rows of sums, each with the strata it counts in, so that one
aggregation makes overall, both margins and the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats, text, vocab
from . import cluster

PHASES = vocab.STAGES[:3]


def level(phase: str = "highest_phase", outcome: str = "outcome") -> Column:
    """How far a candidate came; an approval or a launch counts whatever the phase says."""
    base = vocab.lookup(F.col(phase), {k: v for k, v in vocab.FUNNEL_LEVEL.items() if k.startswith("Phase")}, -1)
    return F.when(F.col(outcome) == "Approved", F.greatest(base, F.lit(3))).when(F.col(outcome) == "Commercialized", F.greatest(base, F.lit(4))).otherwise(base)


def resolved(null_counts: bool = True) -> Column:
    """Whether the outcome is known; a missing outcome counts as `null_counts` says."""
    return F.coalesce(~F.col("outcome").isin("Ongoing", "Unknown"), F.lit(null_counts))


def joined(cands: DataFrame, attributes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Candidates with their attributes and outcomes, null where they have none; the labels have a row per candidate at most."""
    return cands.join(attributes, "candidate_id", "left").join(outcomes, "candidate_id", "left")


def _places(modality: Column, area: Column) -> Column:
    """The strata that labels count in: a missing or empty one makes no stratum, but counts in `overall`."""
    none = F.lit(None).cast("string")
    m, a = (F.nullif(x, F.lit("")) for x in (modality, area))
    place = lambda name, x, y: F.struct(F.lit(name).alias("stratum"), x.alias("modality"), y.alias("disease_area"))
    return F.array_compact(F.array(place("overall", none, none), F.when(m.isNotNull(), place("modality", m, none)), F.when(a.isNotNull(), place("disease_area", none, a)), F.when(m.isNotNull() & a.isNotNull(), place("modality_disease_area", m, a))))


#: A contribution: so many candidates of a level (null if their outcomes are open), and so many spans of a transition with their days together.
_PART = ("one", "level", "step", "days", "n")
_MARKET = len(PHASES)


def _days(start: str, end: str) -> Column:
    """Days of a span that ends after it starts."""
    days = F.datediff(end, start)
    return F.when(days > 0, days).cast("long")


def _part(**values: Column) -> Column:
    kinds = {"one": "long", "level": "int", "step": "int", "days": "long", "n": "long"}
    return F.struct(*(values.get(k, F.lit(None)).cast(kinds[k]).alias(k) for k in _PART))


def _tallied(*parts: DataFrame) -> DataFrame:
    """The funnel of contributions with the strata that each counts in (`places`, `part`); without any there is `overall` with
    zeros, for a row of nothing is added to it."""
    none = F.lit(None).cast("string")
    place = F.struct(F.lit("overall").alias("stratum"), none.alias("modality"), none.alias("disease_area"))
    rows = parts[0].sparkSession.range(1).select(place.alias("place"), _part(one=F.lit(0)).alias("part"))
    for part in parts:
        rows = rows.unionByName(part.select(F.explode("places").alias("place"), "part"))
    rows = rows.select("place.*", "part.*")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    sums = rows.groupBy("stratum", "modality", "disease_area").agg(
        F.coalesce(F.sum("one"), F.lit(0)).alias("candidate_count"), *(total("one", F.col("level") >= i).alias(f"c{i}") for i in range(5)),
        *(total(c, F.col("step") == i).alias(f"{c[0]}{i}") for i in range(4) for c in ("days", "n")),
    )
    mean = [F.try_divide(F.col(f"d{i}"), F.col(f"n{i}") * F.lit(365.25)).alias(f"y{i}") for i in range(4)]
    steps = ", ".join(f"'{a}', '{b}', c{i + 1}, c{i}, y{i}, n{i}" for i, (a, b) in enumerate(zip(vocab.STAGES, vocab.STAGES[1:], strict=False)))
    out = sums.select("*", *mean).select("stratum", "modality", "disease_area", "candidate_count", F.expr(f"stack(4, {steps}) AS (from_phase, to_phase, numerator, denominator, avg_duration_years, n_durations)"))
    return out.withColumn("rate", stats.ratio(F.col("numerator"), F.col("denominator")))


def _span_sums(phase: Column, days: Column) -> list[Column]:
    """Days and number of a study's spans in each phase."""
    return [f(F.when(phase == p, days)).alias(f"{name}{i}") for i, p in enumerate(PHASES) for name, f in (("d", F.sum), ("n", F.count))]


def _spans() -> Column:
    """The contributions of a study's sums: phases that it has spans in."""
    each = F.array(*(_part(one=F.lit(0), step=F.lit(i), days=F.col(f"d{i}"), n=F.col(f"n{i}")) for i in range(len(PHASES))))
    return F.filter(each, lambda x: x["n"] > 0)


def _study_places(labels: Column) -> Column:
    """The strata that any of a study's (modality, disease_area) labels is in."""
    return F.array_distinct(F.flatten(F.transform(labels, lambda x: _places(x["modality"], x["disease_area"]))))


def funnel(cands: DataFrame, trials: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(stratum, modality, disease_area, candidate_count, from_phase, to_phase, numerator, denominator, avg_duration_years, n_durations, rate).

    A null or empty modality or area counts in `overall` only. Without candidates there is `overall` with zeros. With `trials`
    the phases have mean years over all trial rows of a study that the stratum's candidates name, whoever's rows they are. Which
    studies they name is told by `labels` (of membership.labels()), or else by the candidates' lists of trials.
    Candidates are summed by their labels, and rows by their study, before anything is dealt to strata.
    """
    market = _days("approval_date", "market_date")
    labels_of = cands.groupBy("modality", "disease_area", F.when(resolved(), level()).alias("level")).agg(F.count("*").alias("one"), F.sum(market).alias("days"), F.count(market).alias("n"))
    parts = [labels_of.select(_places(F.col("modality"), F.col("disease_area")).alias("places"), _part(one=F.col("one"), level=F.col("level"), step=F.lit(_MARKET), days=F.col("days"), n=F.col("n")).alias("part"))]
    if trials is not None:
        if labels is None:
            labels = cands.select("modality", "disease_area", F.explode(F.array_distinct("trial_ids")).alias("nct_id")).groupBy("nct_id").agg(F.collect_set(F.struct("modality", "disease_area")).alias("labels"))
        days = _days("start_date", "completion_date")
        sums = trials.where(F.col("phase").isin(*PHASES) & days.isNotNull()).groupBy("nct_id").agg(*_span_sums(F.col("phase"), days))
        parts.append(sums.join(labels, "nct_id").select(_study_places(F.col("labels")).alias("places"), F.explode(_spans()).alias("part")))
    return _tallied(*parts)


def of_trials(trials: DataFrame, key: cluster.Strategy = cluster.string_key) -> DataFrame:
    """funnel() of the candidates that the trials cluster to, from one pass over the trials.

    Rows get their candidate's labels in one shuffle. A second gathers each study's labels and first rows of candidates, and sums
    its spans, from which both kinds of contribution come. Rows are dealt by study before anything is gathered: a task that has
    candidates has about one row of each study, and would make, sort and write lists of one. Contributions of the same labels are
    summed before they are dealt to strata, as there are far fewer sets of labels than candidates and studies.
    """
    rows = cluster.labelled(trials, key)
    market = _days("approval_date", "market_date")
    first = _part(one=F.lit(1), level=F.when(resolved(), level()), step=F.when(market.isNotNull(), F.lit(_MARKET)), days=market, n=F.when(market.isNotNull(), F.lit(1)))
    dealt = rows.select("nct_id", "modality", "disease_area", F.when(F.col("is_first"), first).alias("part"), "phase", _days("start_date", "completion_date").alias("span")).repartition("nct_id")
    studies = dealt.groupBy(F.xxhash64("nct_id"), "nct_id").agg(F.collect_list(F.struct(F.struct("modality", "disease_area").alias("label"), "part")).alias("all"), *_span_sums(F.col("phase"), F.col("span")))
    studies = studies.withColumn("labels", F.sort_array(F.array_distinct("all.label")))
    own = F.transform(F.filter("all", lambda x: x["part"].isNotNull()), lambda x: F.struct(F.array(x["label"]).alias("labels"), x["part"].alias("part")))
    shared = F.transform(_spans(), lambda s: F.struct(F.col("labels"), s.alias("part")))
    each = studies.select(F.explode(F.concat(own, shared)).alias("x")).select("x.labels", "x.part.*")
    sums = each.groupBy("labels", "level", "step").agg(*(F.sum(x).alias(x) for x in ("one", "days", "n")))
    return _tallied(sums.select(_study_places(F.col("labels")).alias("places"), _part(**{x: F.col(x) for x in _PART}).alias("part")))


def transition(frame: DataFrame, keys: list[str]) -> DataFrame:
    """The reporting form: a missing outcome is not resolved, and there are no durations."""
    rows = frame.withColumns({"level": level(), "known": resolved(False)})
    reached = [F.sum((F.col("known") & (F.col("level") >= i)).cast("long")).alias(f"c{i}") for i in range(5)]
    pairs = ", ".join(f"'{a}', '{b}', c{i + 1}, c{i}" for i, (a, b) in enumerate(zip(vocab.STAGES, vocab.STAGES[1:], strict=False)))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("candidate_count"), *reached)
    out = counts.select(*keys, "candidate_count", F.expr(f"stack(4, {pairs}) AS (from_phase, to_phase, numerator, denominator)"))
    return out.withColumn("rate", stats.ratio(F.col("numerator"), F.col("denominator")))


def rebucketed(rows: DataFrame, by: str = "disease_area", to: str = "area", keep: tuple[str, ...] = ()) -> DataFrame:
    """Funnel rows in display areas, within the columns `keep`: counts add up, durations weigh by their denominators."""
    weight = F.when(F.col("avg_duration_years").isNotNull(), F.col("denominator"))
    out = rows.groupBy(*keep, text.display_area(F.col(by)).alias(to), "from_phase", "to_phase").agg(
        F.sum("candidate_count").alias("candidate_count"), F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.try_divide(F.sum(F.col("avg_duration_years") * weight), F.sum(weight).cast("double")).alias("avg_duration_years")
    )
    return out.withColumn("rate", stats.ratio(F.col("numerator"), F.col("denominator")))


def oncology(rows: DataFrame) -> DataFrame:
    """Oncology against the rest, both present even if empty: display areas decide, so aliases of oncology would count."""
    side = F.when(text.display_area(F.col("disease_area")) == "Oncology", "Oncology").otherwise("Non-Oncology")
    sums = rows.groupBy(side.alias("side"), "from_phase").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    pairs = [(s, a) for s in ("Oncology", "Non-Oncology") for a in vocab.STAGES[:-1]]
    dim = rows.sparkSession.createDataFrame(pairs, "side string, from_phase string")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return dim.join(sums, ["side", "from_phase"], "left").select("side", "from_phase", zero("numerator"), zero("denominator")).withColumn("rate", stats.ratio(F.col("numerator"), F.col("denominator")))


def loa(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Likelihood of approval from each stage: the product of the rates from there on; from the market it is 1."""
    wide = rows.groupBy(*keys).agg(*(f(F.when(F.col("from_phase") == s, F.col(c))).alias(f"{n}{i}") for i, s in enumerate(vocab.STAGES[:-1]) for n, f, c in (("r", F.max, "rate"), ("d", F.max, "denominator"))))
    out, product = {}, F.lit(1.0)
    for i in range(3, -1, -1):
        product = F.col(f"r{i}") * product
        out[f"loa_{i + 1}"] = product
    counts = {f"n_{i + 1}": F.col(f"d{i}") for i in range(4)}
    return wide.select(*keys, *(c.alias(k) for k, c in (out | counts).items()), F.lit(1.0).alias("loa_market"))


def loa_table(rows: DataFrame) -> DataFrame:
    """Likelihood of approval by display area, greatest first, with all indications at the end, from one reading of the funnel."""
    of = F.when(F.col("stratum") == "overall", "All indications").otherwise(text.display_area(F.col("disease_area")))
    sums = rows.where(F.col("stratum").isin("overall", "disease_area")).groupBy(of.alias("area"), "from_phase").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    out = loa(sums.withColumn("rate", stats.ratio(F.col("numerator"), F.col("denominator"))), ["area"])
    return out.orderBy(F.col("area") == "All indications", F.desc("loa_1"), "area")
