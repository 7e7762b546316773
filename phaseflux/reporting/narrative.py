"""Texts from the small tables of a report. References to figures and tables stand in them as {{figure:key:caption}}.

Rows are plain dictionaries: of the funnel (from_phase, numerator, denominator, rate, avg_duration_years) and of likelihoods
(a name, loa_1 to loa_4, n_1 to n_4). Ranks break ties by name.
"""

from __future__ import annotations

from ..functions import vocab

Rows = list[dict]
STEPS = ("Phase 1", "Phase 2", "Phase 3", "Approval")


def pct(x: float) -> str:
    return f"{x * 100:.1f}%"


def fold(a: float, b: float) -> str:
    """The ratio of two numbers in words."""
    if b == 0:
        return vocab.INFINITE
    ratio = a / b
    if ratio >= 2.5:
        return f"{ratio:.0f}-fold higher than"
    if ratio >= 1.8:
        return f"nearly {round(ratio)}-fold higher than"
    return next((words for least, words in vocab.FOLDS if ratio >= least), vocab.FEWEST)


def total(row: dict) -> int:
    """All denominators of a row of likelihoods."""
    return sum(row[f"n_{i}"] or 0 for i in (1, 2, 3, 4))


def ranked(rows: Rows, name: str) -> Rows:
    """Rows with any denominator, by likelihood from phase 1, greatest first."""
    return sorted((r for r in rows if total(r) > 0), key=lambda r: (-r["loa_1"], r[name]))


def _step(funnel: Rows, phase: str) -> dict | None:
    return next((r for r in funnel if r["from_phase"] == phase and r["denominator"] > 0), None)


def _years(funnel: Rows) -> list[tuple[str, float]]:
    return [(p, r["avg_duration_years"]) for p in STEPS for r in funnel if r["from_phase"] == p and r["avg_duration_years"] is not None]


def _list(rows: Rows, name: str, value: str = "loa_1") -> str:
    return ", ".join(f"{r[name]} ({pct(r[value])})" for r in rows)


def executive(overall: dict, funnel: Rows, areas: Rows, modalities: Rows, sides: Rows, sponsors: dict | None) -> list[str]:
    """The main results, a sentence each."""
    out = [f"From phase 1, {pct(overall['loa_1'])} of candidates are likely to reach the market (n={total(overall):,})."]
    if two := _step(funnel, "Phase 2"):
        out.append(f"Phase 2 let {pct(two['rate'])} of candidates pass (n={two['denominator']:,}).")
    by_area = ranked(areas, "area")
    if by_area and by_area[0]["loa_1"] > 0 and by_area[-1]["loa_1"] > 0:
        best, worst = by_area[0], by_area[-1]
        out.append(f"{best['area']} had the greatest likelihood ({pct(best['loa_1'])}, n={total(best):,}), {best['loa_1'] / worst['loa_1']:.1f} times that of {worst['area']} ({pct(worst['loa_1'])}).")
    side = {r["side"]: r for r in sides}
    if len(side) == 2 and any(r["loa_1"] > 0 for r in sides):
        a, b = side["Non-Oncology"]["loa_1"], side["Oncology"]["loa_1"]
        out.append(f"Outside oncology the likelihood ({pct(a)}) was {fold(a, b)} in oncology ({pct(b)}).")
    if by_modality := ranked(modalities, "modality"):
        out.append(f"Of the modalities, {by_modality[0]['modality']} had the greatest likelihood ({pct(by_modality[0]['loa_1'])}).")
    if areas and (years := _years(funnel)):
        out.append(f"The way from phase 1 to the market took {sum(y for _, y in years):.1f} years on average.")
    if sponsors and sponsors["uniques"]:
        out.append(f"{sponsors['uniques']:,} sponsors took part; {sponsors['singles']:,} of them ({sponsors['singles_pct']:.0f}%) with a single candidate.")
    return out


def introduction(meta: dict, peptide_only: bool) -> str:
    span = f"{meta['first_year']}–{meta['last_year']}" if meta["first_year"] is not None else "the period studied"
    kind = "peptide candidates" if peptide_only else "drug candidates"
    return (
        f"This report measures how often {kind} pass from one phase to the next, and how long that takes, over {span}.\n\n"
        f"It counts {meta['transitions']:,} transitions of {meta['n_candidates']:,} candidates of {meta['n_sponsors']:,} sponsors. A transition is counted when a candidate advances or is given up; the rate of a phase is the share that advances."
    )


def overall_success(funnel: Rows) -> str:
    if len(funnel) < 2:
        return "There is too little data for rates of success."
    out = ["A rate divides the candidates that advanced by those that advanced or were given up; their number is n."]
    out += [f"{p}: {pct(r['rate'])} advanced (n={r['denominator']:,})." for p in STEPS if (r := _step(funnel, p))]
    return "\n\n".join([*out, "{{figure:overall_spider:Rates of all phases, all areas and modalities.}}"])


def spider(funnel: Rows) -> str:
    out = []
    if two := _step(funnel, "Phase 2"):
        out.append(f"The second phase is where most is decided: {pct(two['rate'])} of candidates pass it.")
    if years := _years(funnel):
        out.append(f"From phase 1 to the market, {sum(y for _, y in years):.1f} years pass on average.")
    return "\n\n".join([*out, "{{figure:overall_spider:Rates of all phases.}}"])


def disease_success(areas: Rows, funnel: Rows) -> str:
    """Rates by area: range of each phase; for phase 2 who is above the whole, and who is below 85 % of it."""
    if not areas:
        return "There are no disease areas."
    out = [f"Candidates fall into {len({r['area'] for r in areas})} disease areas.", "{{figure:disease_heatmap:Rates by disease area; n counts the candidates that advanced or were given up.}}"]
    for i, phase in enumerate(STEPS, 1):
        rows = sorted((r for r in areas if r["from_phase"] == phase and r["denominator"] > 0), key=lambda r: (-r["rate"], r["area"]))
        whole = (_step(funnel, phase) or {"rate": 0.0})["rate"]
        if rows:
            best, worst = rows[0], rows[-1]
            out.append(f"{phase}: from {pct(worst['rate'])} ({worst['area']}, n={worst['denominator']:,}) to {pct(best['rate'])} ({best['area']}, n={best['denominator']:,}); all areas {pct(whole)}.")
            if phase == "Phase 2":
                if above := [r for r in rows if r["rate"] > whole]:
                    out.append(f"Above the whole are {_list(above, 'area', 'rate')}.")
                if below := [r for r in rows if r["rate"] < 0.85 * whole]:
                    out.append(f"Far below it are {_list(below[-3:], 'area', 'rate')}.")
            if phase == "Phase 3":
                out.append(f"{sum(r['rate'] < whole for r in rows)} areas are below the whole.")
        if i < 4:
            out.append(f"{{{{figure:phase{i}_by_disease:{phase} rates by disease area.}}}}")
    return "\n\n".join(out)


def loa_by_area(areas: Rows, overall: dict) -> str:
    rows = ranked(areas, "area")
    if not areas:
        return ""
    whole = overall["loa_1"]
    out = ["The likelihood of approval multiplies the rates of all phases that are left.", f"Over all areas, {pct(whole)} of candidates (n={total(overall):,}) come from phase 1 to the market."]
    if len(rows) > 1:
        best, worst = rows[0], rows[-1]
        times = best["loa_1"] / worst["loa_1"] if worst["loa_1"] > 0 else 0
        out.append(f"It ranges from {pct(worst['loa_1'])} ({worst['area']}, n={total(worst):,}) to {pct(best['loa_1'])} ({best['area']}, n={total(best):,}), {times:.0f} times as much." if times >= 2 else f"It ranges from {pct(worst['loa_1'])} ({worst['area']}) to {pct(best['loa_1'])} ({best['area']}), {times:.1f} times as much.")
        if more := [r for r in rows[1:] if r["loa_1"] > whole]:
            out.append(f"Also above the whole: {', '.join(r['area'] for r in more)}.")
        if less := [r for r in rows if r["loa_1"] < 0.85 * whole]:
            out.append(f"Clearly below it: {', '.join(r['area'] for r in less[:4])}.")
    return "\n\n".join([*out, "{{figure:loa_by_disease:Likelihood from phase 1 by disease area.}}", "{{table:loa_by_disease:Likelihood by disease area, with n.}}"])


def modality(modalities: Rows, overall: dict) -> str:
    rows = ranked(modalities, "modality")
    if not rows:
        return ""
    best, whole = rows[0], overall["loa_1"]
    out = [f"Of the modalities, {best['modality']} did best: {pct(best['loa_1'])} (n={total(best):,}), {fold(best['loa_1'], whole)} the whole ({pct(whole)})."]
    if more := [r for r in rows[1:] if r["loa_1"] > whole]:
        out.append(f"Others above it: {_list(more, 'modality')}.")
    if len(rows) > 1:
        out.append(f"{rows[-1]['modality']} had the least, {pct(rows[-1]['loa_1'])} (n={total(rows[-1]):,}).")
    return "\n\n".join([*out, "{{figure:loa_by_modality:Likelihood from phase 1 by modality.}}", "{{table:loa_by_modality:Likelihood by modality, with n.}}"])


def oncology(sides: Rows, steps: Rows, overall: dict) -> str:
    """The two sides: share of the transitions, ratio in words, and the phases that differ by more than 3 points."""
    side = {r["side"]: r for r in sides}
    if len(side) < 2:
        return ""
    one, rest, n = side["Oncology"], side["Non-Oncology"], total(overall)
    out = [f"Oncology makes {100 * total(one) / n if n else 0:.0f}% of the {n:,} transitions.", f"Outside oncology the likelihood, {pct(rest['loa_1'])} (n={total(rest):,}), is {fold(rest['loa_1'], one['loa_1'])} in oncology, {pct(one['loa_1'])} (n={total(one):,})."]
    at = {(r["side"], r["from_phase"]): r for r in steps}
    apart = [f"{p} {pct(a['rate'])} against {pct(b['rate'])}" for p in STEPS if (a := at.get(("Oncology", p))) and (b := at.get(("Non-Oncology", p))) and a["denominator"] and b["denominator"] and abs(a["rate"] - b["rate"]) > 0.03]
    if apart:
        out.append(f"They differ at {'; '.join(apart)}.")
    a, b = at.get(("Oncology", "Approval")), at.get(("Non-Oncology", "Approval"))
    if a and b and a["rate"] > b["rate"]:
        out.append(f"From approval to the market oncology does better, {pct(a['rate'])} (n={a['denominator']:,}) against {pct(b['rate'])} (n={b['denominator']:,}).")
    return "\n\n".join([*out, "{{figure:oncology_comparison:Rates and likelihood in and outside oncology.}}", "{{table:oncology_comparison:Likelihood in and outside oncology, with n.}}"])


def timeline(areas: Rows, funnel: Rows, extremes: Rows) -> str:
    """Mean years: the whole, shortest and longest area, and phases in which an area is more than a year from the mean."""
    years = _years(funnel)
    if not years:
        return "There are too few dates for a timeline."
    whole = sum(y for _, y in years)
    out = [f"From phase 1 to the market {whole:.1f} years pass on average: {', '.join(f'{y:.1f} in {p}' for p, y in years)}."]
    sums: dict[str, float] = {}
    for r in areas:
        if r["avg_duration_years"] is not None:
            sums[r["area"]] = sums.get(r["area"], 0.0) + r["avg_duration_years"]
    if sums:
        order = sorted(sums, key=lambda x: (sums[x], x))
        out.append(f"{sum(v < whole for v in sums.values())} areas take less. {order[0]} is the fastest with {sums[order[0]]:.1f} years, {order[-1]} the slowest with {sums[order[-1]]:.1f}.")
        mean = dict(years)
        for r in sorted(extremes, key=lambda r: STEPS.index(r["from_phase"])):
            if (m := mean.get(r["from_phase"])) is None:
                continue
            if r["longest_years"] - m > 1:
                out.append(f"In {r['from_phase']}, {r['longest']} takes the longest, {r['longest_years']:.1f} years (mean {m:.1f}).")
            elif m - r["shortest_years"] > 1:
                out.append(f"In {r['from_phase']}, {r['shortest']} takes the shortest, {r['shortest_years']:.1f} years (mean {m:.1f}).")
    return "\n\n".join([*out, "{{figure:timeline_by_disease:Mean years of each phase by disease area.}}"])


def periods(labels: list[str], excluded: int, weighted: dict[str, float], moved: Rows) -> str:
    if len(labels) < 2:
        return ""
    left_out = f" ({excluded:,} candidates without a start date are left out)" if excluded else ""
    out = [f"Candidates are split by start year into {', '.join(labels)}{left_out}."]
    if len(weighted) > 1 and (some := [f"{x} {pct(weighted[x])}" for x in labels if weighted.get(x, 0) > 0]):
        out.append(f"Mean likelihood, weighted by n: {'; '.join(some)}.")
    for kind in ("improvement", "decline"):
        if rows := [r for r in moved if r["kind"] == kind]:
            out.append(f"Areas in {kind}: {'; '.join(f'{r['area']} ({pct(r['loa_first'])} → {pct(r['loa_last'])})' for r in rows)}.")
    return "\n\n".join([*out, "{{figure:time_period_comparison:Likelihood by disease area and period.}}", "{{table:time_period_loa:Likelihood by period and disease area.}}"])


def trend(years: list[int], changes: Rows) -> str:
    if not years:
        return ""
    if len(years) < 2:
        return "The years are too few for a trend."
    out = [f"Modalities are followed over {len(years)} years ({years[0]}–{years[-1]})."]
    for words, rows in (("gain", [r for r in changes if r["change"] > 0]), ("lose", [r for r in changes if r["change"] < 0])):
        if rows := sorted(rows, key=lambda r: (-r["change"], r["modality"]))[:3]:
            out.append(f"Those that {words} share: {'; '.join(f'{r['modality']} ({r['first_share']:.0%} → {r['last_share']:.0%})' for r in rows)}.")
    return "\n\n".join([*out, "{{figure:modality_proportion:Share of each modality by start year.}}"])


def sponsor(top: Rows, stats: dict) -> str:
    if not stats or not stats["uniques"]:
        return ""
    out = [f"There are {stats['uniques']:,} sponsors; {stats['singles']:,} ({stats['singles_pct']:.0f}%) have one candidate. The ten largest have {stats['top10_pct']:.0f}% of all candidates."]
    if len(top) >= 3:
        out.append(f"The largest are {', '.join(f'{r['sponsor']} ({r['n_candidates']})' for r in top[:3])}.")
    return "\n\n".join([*out, "{{figure:sponsor_concentration:Sponsors by their number of candidates.}}"])
