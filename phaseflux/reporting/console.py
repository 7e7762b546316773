"""Small results as text for a terminal."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.sinks import Rows, collected


def table(rows: Rows, places: int = 3) -> str:
    """Columns under their names, numbers to the right."""
    if not rows:
        return "(none)"
    show = lambda v: "—" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    lines = [list(rows[0]), *([show(v) for v in r.values()] for r in rows)]
    wide = [max(len(x[i]) for x in lines) for i in range(len(lines[0]))]
    right = [not isinstance(v, str) for v in rows[0].values()]
    return "\n".join("  ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(line, wide, right, strict=True)).rstrip() for line in lines)


def evaluation(metrics: DataFrame, whole: DataFrame, skipped: int = 0) -> str:
    """The classes' metrics, their means and the whole."""
    one = collected(whole)[0]
    names = ("class", "precision", "recall", "f1", "accuracy", "support")
    rows = [{k: r[k] for k in names} for r in collected(metrics)]
    rows.append({"class": "macro avg"} | {k: one[f"macro_{k}"] for k in names[1:5]} | {"support": None})
    return f"Outcome validation: {one['matched']} matched, {skipped} skipped, {one['unmatched']} unmatched\n{table(rows)}\n3-class accuracy {one['accuracy']:.3f}"


def errors(found: DataFrame, matched: int) -> str:
    """False positives and negatives of each task."""
    rows, out = collected(found), []
    for task in ("approval", "commercialization"):
        out.append(f"{task.capitalize()} error cases ({matched} matched rows)")
        for kind, name in (("FP", "False positives"), ("FN", "False negatives")):
            own = [r for r in rows if r["task"] == task and r["error"] == kind]
            out += [f"  {name} ({len(own)})", *(f"    - {r['drug_name']} | {r['indication']} | predicted {r['predicted']}" for r in own)] if own else [f"  {name} (0)", "    (none)"]
    return "\n".join(out)


def coverage(kinds: DataFrame, before: int, after: int) -> str:
    """Trial rows by kind of match, with their share, and the candidates before and after merging."""
    rows = collected(kinds)
    whole = sum(r["n_trial_rows"] for r in rows)
    shown = [{"match": r["match"], "candidates": r["n_candidates"], "trial rows": r["n_trial_rows"], "share": f"{100 * r['n_trial_rows'] / whole:.1f}%" if whole else "N/A"} for r in rows]
    return f"{table(shown)}\nCandidates before {before}, after {after}"


def ledger(stages: DataFrame) -> str:
    return table(collected(stages.orderBy("stage")), 6)


def progress(rows: Rows, done: int) -> str:
    return f"{done}/{len(rows)} labelled, {len(rows) - done} remaining"
