"""The parts of a report: each makes tables, figures and a text from the context; compose() runs those that apply, in order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import funnel as funnels
from ..operators import report
from ..sources.sinks import Rows, collected
from . import figures, narrative

PEPTIDE = "peptide"
LABELS = list(vocab.STEP_LABELS.values())


class Context:
    """What the components read: the candidates (a frame that may be read often) and the funnel, collected once; all else is derived from them when it is asked for."""

    def __init__(self, cands: DataFrame, funnel: DataFrame, as_of: dt.date, peptide_only: bool = False, periods: list[tuple[int, int]] | None = None):
        self.cands, self.as_of, self.peptide_only, self._periods = cands, as_of, peptide_only, periods
        self.funnel = cands.sparkSession.createDataFrame(funnel.toArrow())  # four rows for each stratum

    @cached_property
    def displayed(self) -> DataFrame:
        return report.displayed(self.funnel)

    def rows(self, stratum: str, shown: bool = False) -> Rows:
        return collected((self.displayed if shown else self.funnel).where(F.col("stratum") == stratum))

    @cached_property
    def whole(self) -> Rows:
        """The funnel of all candidates, or of the peptides, if there are any, in a report on them."""
        own = [r for r in self.rows("modality") if r["modality"] == PEPTIDE] if self.peptide_only else []
        return own or self.rows("overall")

    @cached_property
    def raw_areas(self) -> DataFrame:
        """The funnel by area, in a report on peptides theirs only."""
        if not self.peptide_only:
            return self.funnel.where("stratum = 'disease_area'")
        return self.funnel.where((F.col("stratum") == "modality_disease_area") & (F.col("modality") == PEPTIDE)).withColumn("stratum", F.lit("disease_area"))

    @cached_property
    def areas(self) -> Rows:
        return collected(self.displayed.where("stratum = 'disease_area'").withColumnRenamed("disease_area", "area"))

    def loa(self, by: str) -> Rows:
        frame = self.displayed.where(F.col("stratum") == ("modality" if by == "modality" else "disease_area")).withColumnRenamed("disease_area", "area")
        return collected(funnels.loa(frame, [by]).orderBy(F.desc("loa_1"), by))

    @cached_property
    def overall(self) -> dict:
        return collected(funnels.loa(self.displayed.where("stratum = 'overall'"), ["stratum"]))[0]

    @cached_property
    def area_loa(self) -> Rows:
        return self.loa("area")

    @cached_property
    def modality_loa(self) -> Rows:
        return self.loa("modality")

    @cached_property
    def sides(self) -> DataFrame:
        return funnels.oncology(self.funnel.where("stratum = 'disease_area'"))

    @cached_property
    def side_loa(self) -> Rows:
        return collected(funnels.loa(self.sides, ["side"]).orderBy(F.desc("side")))

    @cached_property
    def years(self) -> dict[int | None, int]:
        return {r["year"]: r["n"] for r in collected(report.start_years(self.cands))}

    @cached_property
    def periods(self) -> list[tuple[int, int]]:
        return self._periods or report.default_periods({y: n for y, n in self.years.items() if y is not None}, self.as_of)

    @cached_property
    def sponsors(self) -> Rows:
        return collected(report.sponsors(self.cands).orderBy(F.desc("n_candidates"), "sponsor"))

    @cached_property
    def sponsor_stats(self) -> dict:
        return collected(report.sponsor_summary(self.cands))[0]

    @cached_property
    def metadata(self) -> dict:
        return collected(report.metadata(self.cands, self.funnel.where("stratum = 'overall'")))[0]


@dataclass
class Result:
    tables: dict[str, Rows] = field(default_factory=dict)
    figures: dict[str, str] = field(default_factory=dict)
    html_figures: dict[str, str] = field(default_factory=dict)
    export: dict = field(default_factory=dict)
    narrative: str = ""


@runtime_checkable
class Component(Protocol):
    """A part of the report."""

    key: str
    order: int
    title: str

    def should_include(self, ctx: Context) -> bool: ...

    def render(self, ctx: Context) -> Result: ...


@dataclass(frozen=True)
class Part:
    """A component made of a function."""

    key: str
    order: int
    title: str
    applies: Callable[[Context], bool]
    make: Callable[[Context], Result]

    def should_include(self, ctx: Context) -> bool:
        return self.applies(ctx)

    def render(self, ctx: Context) -> Result:
        return self.make(ctx)


COMPONENTS: list[Part] = []


def _part(key: str, order: int, title: str, applies: Callable[[Context], bool]) -> Callable[[Callable[[Context], Result]], Callable[[Context], Result]]:
    def add(make: Callable[[Context], Result]) -> Callable[[Context], Result]:
        COMPONENTS.append(Part(key, order, title, applies, make))
        return make

    return add


def _always(ctx: Context) -> bool:
    return True


def _never(ctx: Context) -> bool:
    return False


def _all_modalities(ctx: Context) -> bool:
    return not ctx.peptide_only


def _flat(rows: Rows, name: str | None) -> Rows:
    head = {"stratum": name} if name else {}
    return [{k: r[v] for k, v in head.items()} | {k: r[k] for k in ("from_phase", "to_phase", "numerator", "denominator", "rate")} for r in rows]


def _stage(r: dict) -> int:
    return vocab.FUNNEL_LEVEL[r["from_phase"]]


def _with_all(rows: Rows, name: str, overall: dict) -> Rows:
    keys = [f"loa_{i}" for i in (1, 2, 3, 4)] + ["loa_market"] + [f"n_{i}" for i in (1, 2, 3, 4)]
    return [{"stratum": r[name]} | {k: r[k] for k in keys} for r in rows] + [{"stratum": "All indications"} | {k: overall[k] for k in keys}]


def _grid(frame: DataFrame, by: str, drop: bool) -> Rows:
    return sorted(collected(report.grid(frame, by, drop)), key=lambda r: (r[by], _stage(r)))


def wide(cells: Rows, by: str) -> Rows:
    """A grid's cells as a row for each label, five columns for each transition; an interval without a rate is blank."""
    out: dict[str, dict] = {}
    for r in cells:
        row, step, some = out.setdefault(r[by], {"Row Label": r[by]}), vocab.STEP_LABELS[r["from_phase"]], r["rate"] is not None
        row |= {f"{step} Rate": r["rate"], f"{step} n": r["numerator"], f"{step} denom": r["denominator"], f"{step} CI Low": r["ci_low"] if some else None, f"{step} CI High": r["ci_high"] if some else None}
    return list(out.values())


def _views(pairs: DataFrame, by: str, other: str, name: str) -> dict[str, Rows]:
    """A sheet of the grid by one side for each value of the other."""
    cells = sorted(collected(report.grid(pairs, by, by == "disease_area", other)), key=lambda r: (r[other], r[by], _stage(r)))
    return {f"{name} - {value}": wide([r for r in cells if r[other] == value], by) for value in dict.fromkeys(r[other] for r in cells)}


def _heat(title: str, cells: Rows, by: str) -> str:
    labels = list(dict.fromkeys(r[by] for r in cells))
    return figures.heat(title, [(x, [(r["rate"], r["denominator"]) for r in cells if r[by] == x]) for x in labels], LABELS)


@_part("funnel", 10, "Phase Transition Success Rates", _never)
def _funnel(ctx: Context) -> Result:
    rows = sorted(ctx.whole, key=_stage)
    return Result(tables={"funnel_overall": _flat(rows, None)}, narrative=narrative.overall_success(rows))


@_part("spider", 10, "Phase Transition Success Rates", _always)
def _spider(ctx: Context) -> Result:
    whole = sorted(ctx.whole, key=_stage)
    frame = ctx.funnel.where("stratum = 'overall'").unionByName(ctx.raw_areas)
    drawn: dict[str, list[dict]] = {}
    for r in sorted(collected(report.spiders(frame)), key=lambda r: (r["key"] != "overall_spider", r["label"], _stage(r))):
        drawn.setdefault(r["key"], []).append(r)
    drawn["overall_spider"] = [r | {"label": "Overall", "n": whole[0]["denominator"]} for r in whole]
    shown = {k: figures.radar(f"{v[0]['label']}: rates of success (n={v[0]['n']})", [r["rate"] for r in v], LABELS) for k, v in drawn.items()}
    return Result(figures=shown, narrative=narrative.spider(whole))


@_part("disease_breakdown", 20, "Phase Transition Success by Disease Area", _always)
def _breakdown(ctx: Context) -> Result:
    rows = sorted(collected(ctx.raw_areas), key=lambda r: (r["disease_area"], _stage(r)))
    counts = collected(report.count_bars(ctx.raw_areas, "disease_area"))
    bars = figures.bars("Candidates by disease area", [(r["disease_area"], [r["candidate_count"]]) for r in counts], ["candidates"], [[str(r["candidate_count"])] for r in counts])
    return Result(tables={"funnel_by_disease": _flat(rows, "disease_area")}, figures={"disease_breakdown": bars})


@_part("heatmaps", 30, "Phase-Transition Heatmaps", _all_modalities)
def _heatmaps(ctx: Context) -> Result:
    modalities, areas = ctx.funnel.where("stratum = 'modality'"), ctx.displayed.where("stratum = 'disease_area'")
    by_modality, by_area = _grid(modalities, "modality", False), _grid(areas, "disease_area", True)
    counts = collected(report.count_bars(modalities, "modality"))
    drawn = {
        "modality_breakdown": figures.bars("Candidates by modality", [(r["modality"], [r["candidate_count"]]) for r in counts], ["candidates"], [[str(r["candidate_count"])] for r in counts]),
        "modality_heatmap": _heat("Rates by modality", by_modality, "modality"), "disease_heatmap_all": _heat("Rates by area as labelled", _grid(ctx.funnel.where("stratum = 'disease_area'"), "disease_area", True), "disease_area"),
        "disease_heatmap": _heat("Rates by disease area", by_area, "disease_area"),
    }
    for i, phase in enumerate(("Phase 1", "Phase 2", "Phase 3"), 1):
        rows = collected(report.phase_success(areas, "disease_area", phase))
        drawn[f"phase{i}_by_disease"] = figures.bars(f"{phase} rates by disease area (%)", [(r["disease_area"], [100 * r["rate"]]) for r in rows], ["rate"], [[f"{r['rate']:.1%} (n={r['denominator']})"] for r in rows])
    pairs = ctx.displayed.where("stratum = 'modality_disease_area'")
    views = _views(pairs, "modality", "disease_area", "Modality") | _views(pairs, "disease_area", "modality", "Disease")
    flat = _flat(sorted(ctx.rows("modality"), key=lambda r: (r["modality"], _stage(r))), "modality")
    return Result({"funnel_by_modality": flat}, drawn, export={"Modality Heatmap": wide(by_modality, "modality"), "Disease Heatmap": wide(by_area, "disease_area"), **views}, narrative=narrative.disease_success(ctx.areas, ctx.rows("overall")))


@_part("bubble_heatmaps", 35, "Interactive Bubble Heatmaps", _all_modalities)
def _bubbles(ctx: Context) -> Result:
    page = lambda by, other: figures.bubble_page(f"Rates by {by.replace('_', ' ')}: size by n, colour by rate", collected(report.bubble_views(ctx.displayed, by, other)), by, vocab.STEP_LABELS)
    return Result(html_figures={"modality_bubble_heatmap": page("modality", "disease_area"), "disease_bubble_heatmap": page("disease_area", "modality")})


@_part("loa", 40, "Likelihood of Approval", _all_modalities)
def _loa(ctx: Context) -> Result:
    tables, drawn = {}, {}
    for key, by, rows in (("loa_by_disease", "area", ctx.area_loa), ("loa_by_modality", "modality", ctx.modality_loa)):
        shown = sorted((r for r in rows if narrative.total(r) >= report.LEAST), key=lambda r: (r["loa_1"], r[by]))
        drawn[key] = figures.bars(f"Likelihood from phase 1 (%), all {ctx.overall['loa_1']:.1%}", [(r[by], [100 * r["loa_1"]]) for r in shown], ["loa"], [[f"{r['loa_1']:.1%} (n={narrative.total(r)})"] for r in shown])
        tables[key] = _with_all(rows, by, ctx.overall)
    return Result(tables, drawn, export={"LOA by Disease": tables["loa_by_disease"], "LOA by Modality": tables["loa_by_modality"]}, narrative="\n\n".join([narrative.loa_by_area(ctx.area_loa, ctx.overall), narrative.modality(ctx.modality_loa, ctx.overall)]))


@_part("oncology", 50, "Oncology vs Non-Oncology", _all_modalities)
def _oncology(ctx: Context) -> Result:
    table = _with_all(sorted(ctx.side_loa, key=lambda r: -r["loa_1"]), "side", ctx.overall)
    chart, steps = collected(report.oncology_chart(ctx.sides)), [*vocab.STAGES[:-1], "LOA"]
    at = {(r["side"], r["step"]): r["pct"] for r in chart}
    drawn = figures.bars("Oncology against the rest (%)", [(s, [at[x, s] for x in ("Oncology", "Non-Oncology")]) for s in steps], ["Oncology", "Non-Oncology"], [[f"{at[x, s]:.1f}" for x in ("Oncology", "Non-Oncology")] for s in steps])
    return Result({"oncology_comparison": table}, {"oncology_comparison": drawn}, export={"Oncology vs Non-Oncology": table}, narrative=narrative.oncology(ctx.side_loa, collected(ctx.sides), ctx.overall))


@_part("timeline", 60, "Drug Development Timelines", _all_modalities)
def _timeline(ctx: Context) -> Result:
    areas = ctx.displayed.where("stratum = 'disease_area'").withColumnRenamed("disease_area", "area")
    rows = collected(report.timeline(areas, "area"))
    labels = list(dict.fromkeys(r["area"] for r in rows))
    drawn = figures.bars("Mean years by disease area", [(x, [r["years"] for r in rows if r["area"] == x]) for x in labels], LABELS, [["", "", "", f"{next(r['total'] for r in rows if r['area'] == x):.1f}"] for x in labels], True)
    sheet = []
    for name in sorted({r["area"] for r in ctx.areas}):
        years = [r["avg_duration_years"] for r in sorted((r for r in ctx.areas if r["area"] == name), key=_stage)]
        sheet.append({"Disease Area": name} | {f"{x} (yr)": y for x, y in zip(LABELS, years, strict=True)} | {"Total P1→Appr (yr)": sum(y or 0 for y in years[:3]) if any(y is not None for y in years[:3]) else None})
    return Result(figures={"timeline_by_disease": drawn}, export={"Development Timelines": sheet}, narrative=narrative.timeline(ctx.areas, ctx.rows("overall"), collected(report.extremes(areas, "area"))))


@_part("time_period", 70, "LOA by Time Period", _all_modalities)
def _time_period(ctx: Context) -> Result:
    if not ctx.periods:
        return Result()
    each = collected(report.period_area_loa(ctx.cands, ctx.periods))
    labels = [f"{a}–{b}" for a, b in ctx.periods]
    frame = ctx.cands.sparkSession.createDataFrame([(r["area"], r["period"], r["loa"], r["n"]) for r in each], "area string, period string, loa double, n long")
    at = {(r["area"], r["period"]): r for r in each}
    names = sorted({r["area"] for r in each})
    value = lambda x, p: at[x, p]["loa"] if (x, p) in at else 0.0
    order = sorted(names, key=lambda x: (sum(value(x, p) for p in labels), x))
    table = [{"disease_area": x} | {f"loa_{p.replace('–', '-')}": at[x, p]["loa"] if (x, p) in at else None for p in labels} | {f"n_{p.replace('–', '-')}": at[x, p]["n"] if (x, p) in at else 0 for p in labels} for x in names]
    excluded = ctx.years.get(None, 0)
    drawn = figures.bars("Likelihood from phase 1 (%) by period" + (f", {excluded} without a start" if excluded else ""), [(x, [100 * value(x, p) for p in labels]) for x in order], labels)
    weighted = {r["period"]: r["loa"] for r in collected(report.weighted_loa(frame))}
    moved = sorted(collected(report.movers(frame, labels[0], labels[-1])), key=lambda r: (r["kind"], r["at"]))
    return Result({"time_period_loa": table}, {"time_period_comparison": drawn}, export={"Time Period LOA": table}, narrative=narrative.periods(labels, excluded, weighted, moved))


@_part("modality_trend", 80, "Drug Modality Composition Over Time", _all_modalities)
def _trend(ctx: Context) -> Result:
    shares = report.modality_shares(ctx.cands)
    rows = [{"year": r["year"], "modality": r["modality"], "count": r["n"], "pct": r["share"]} for r in collected(shares.orderBy("year", "modality"))]
    if not rows:
        return Result()
    local = ctx.cands.sparkSession.createDataFrame([(r["year"], r["modality"], r["count"], r["pct"]) for r in rows], "year int, modality string, n long, share double")
    chart = collected(report.trend_chart(local))
    years, names = sorted({r["year"] for r in chart}), sorted({r["modality"] for r in chart})
    at = {(r["year"], r["modality"]): r["pct"] for r in chart}
    if chart[0]["kind"] == "area":
        drawn = figures.areas("Share of each modality by start year (%)", years, [(m, [at[y, m] for y in years]) for m in names])
    else:
        drawn = figures.bars("Share of each modality by start year (%)", [(str(y), [at[y, m] for m in names]) for y in years], names)
    text = narrative.trend(sorted({r["year"] for r in rows}), collected(report.share_changes(local)))
    return Result({"modality_proportion": rows}, {"modality_proportion": drawn}, {"modality_proportion": drawn}, {"Modality Proportion": rows}, text)


@_part("sponsor", 90, "Sponsor Concentration", _all_modalities)
def _sponsor(ctx: Context) -> Result:
    rows = ctx.sponsors
    if not rows:
        return Result()
    local = ctx.cands.sparkSession.createDataFrame([(r["n_candidates"],) for r in rows], "n_candidates long")
    bins = collected(report.sponsor_bins(local).orderBy("bin"))
    drawn = figures.bars("The 20 largest sponsors by candidates", [(r["sponsor"], [r["n_candidates"]]) for r in rows[:20]], ["candidates"], [[str(r["n_candidates"])] for r in rows[:20]])
    drawn += figures.bars("Sponsors by their number of candidates", [(f"from {r['bin']}", [r["n_sponsors"]]) for r in bins], ["sponsors"], [[str(r["n_sponsors"])] for r in bins])
    return Result({"sponsor_concentration": rows}, {"sponsor_concentration": drawn}, export={"Sponsor Concentration": rows}, narrative=narrative.sponsor(rows, ctx.sponsor_stats))


@_part("candidate_summary", 100, "Candidate Summary", _always)
def _summary(ctx: Context) -> Result:
    return Result(export={"summary": report.summary(ctx.cands, ctx.as_of, PEPTIDE if ctx.peptide_only else None).orderBy("candidate_id")})


@dataclass
class Report:
    """Everything that compose() has made; `sections` has the key, title and result of each part in order."""

    sections: list[tuple[str, str, Result]]
    executive: list[str]
    introduction: str
    summary: DataFrame

    def _merged(self, name: str) -> dict:
        return {k: v for _, _, r in self.sections for k, v in getattr(r, name).items()}

    @property
    def tables(self) -> dict[str, Rows]:
        return self._merged("tables")

    @property
    def figures(self) -> dict[str, str]:
        return self._merged("figures")

    @property
    def html_figures(self) -> dict[str, str]:
        return self._merged("html_figures")

    @property
    def export(self) -> dict[str, Rows]:
        return {k: v for k, v in self._merged("export").items() if k != "summary"}

    @property
    def text(self) -> str:
        return "Executive Summary:\n" + "\n".join(f"  * {x}" for x in self.executive) + f"\n\n{self.introduction}"


def compose(ctx: Context, components: list[Component] | None = None) -> Report:
    """The parts that apply, by their order."""
    parts = sorted((c for c in (COMPONENTS if components is None else components) if c.should_include(ctx)), key=lambda c: c.order)
    sections = [(c.key, c.title, c.render(ctx)) for c in parts]
    full = not ctx.peptide_only
    executive = narrative.executive(ctx.overall, ctx.rows("overall"), ctx.area_loa if full else [], ctx.modality_loa if full else [], ctx.side_loa if full else [], ctx.sponsor_stats if full else None)
    summary = report.summary(ctx.cands, ctx.as_of, PEPTIDE if ctx.peptide_only else None).orderBy("candidate_id")
    return Report(sections, executive, narrative.introduction(ctx.metadata, ctx.peptide_only), summary)
