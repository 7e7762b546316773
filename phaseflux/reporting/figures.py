"""Figures as SVG text, from plain rows. Nothing here needs more than the standard library."""

from __future__ import annotations

import math
from html import escape

WIDTH, ROW = 640, 26
COLOURS = ("#4472C4", "#ED7D31", "#A5A5A5", "#FFC000", "#5B9BD5", "#70AD47", "#264478", "#9E480E", "#636363", "#997300", "#255E91", "#43682B")


def _svg(height: float, body: list[str], title: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{height:.0f}" font-family="sans-serif" font-size="11"><text x="8" y="16" font-size="13">{escape(title)}</text>{"".join(body)}</svg>'


def _text(x: float, y: float, words: str, more: str = "") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}"{more}>{escape(words)}</text>'


def _box(x: float, y: float, w: float, h: float, colour: str, tip: str = "") -> str:
    return f'<rect x="{x:.1f}" y="{y:.1f}" width="{max(w, 0):.1f}" height="{h:.1f}" fill="{colour}"><title>{escape(tip)}</title></rect>'


def empty(title: str) -> str:
    return _svg(60, [_text(8, 40, "no data")], title)


def bars(title: str, rows: list[tuple[str, list[float]]], names: list[str], marks: list[list[str]] | None = None, stacked: bool = False) -> str:
    """Horizontal bars: a row for each label, with a bar for each of `names`, side by side or one after another."""
    if not rows:
        return empty(title)
    most = max([sum(v) if stacked else max(v, default=0) for _, v in rows] + [1e-9])
    scale, body, y = 380 / most, [], 30
    for i, (label, values) in enumerate(rows):
        at = 170.0
        body.append(_text(8, y + 14, label[:28]))
        for j, value in enumerate(values):
            tall = 18 if stacked else 18 / len(values)
            top = y if stacked else y + j * tall
            body.append(_box(at, top, value * scale, tall - 1, COLOURS[j % len(COLOURS)], f"{label}: {names[j]} {value:.3g}"))
            mark = marks[i][j] if marks else ""
            if mark:
                body.append(_text(at + (3 if stacked else value * scale + 3), top + tall - 4, mark))
            at += value * scale if stacked else 0
        y += ROW
    legend = [_box(170 + 110 * j, y + 6, 10, 10, COLOURS[j % len(COLOURS)]) + _text(184 + 110 * j, y + 15, n) for j, n in enumerate(names)] if len(names) > 1 else []
    return _svg(y + 24, body + legend, title)


def heat(title: str, rows: list[tuple[str, list[tuple[float | None, int]]]], names: list[str]) -> str:
    """Rates by row and column, from red to green; a missing one is a dash."""
    if not rows:
        return empty(title)
    body = [_text(180 + 110 * j, 36, n) for j, n in enumerate(names)]
    for i, (label, cells) in enumerate(rows):
        y = 42 + i * ROW
        body.append(_text(8, y + 16, label[:28]))
        for j, (rate, n) in enumerate(cells):
            colour = "#DDDDDD" if rate is None else f"hsl({120 * rate:.0f},60%,70%)"
            body.append(_box(170 + 110 * j, y, 108, ROW - 2, colour) + _text(178 + 110 * j, y + 16, "—" if rate is None else f"{rate:.0%} (n={n})"))
    return _svg(50 + len(rows) * ROW, body, title)


def radar(title: str, values: list[float], names: list[str]) -> str:
    """Values from 0 to 1 on the axes of a wheel."""
    at = lambda i, r: (200 + 120 * r * math.sin(2 * math.pi * i / len(names)), 180 - 120 * r * math.cos(2 * math.pi * i / len(names)))
    ring = lambda rs: " ".join(f"{x:.1f},{y:.1f}" for x, y in (at(i, r) for i, r in enumerate(rs)))
    body = [f'<polygon points="{ring([r] * len(names))}" fill="none" stroke="#CCCCCC"/>' for r in (0.25, 0.5, 0.75, 1.0)]
    body.append(f'<polygon points="{ring(values)}" fill="#ED7D31" fill-opacity="0.3" stroke="#ED7D31"/>')
    body += [_text(*at(i, 1.15), f"{n} {values[i]:.0%}", ' text-anchor="middle"') for i, n in enumerate(names)]
    return _svg(350, body, title)


def areas(title: str, years: list[int], series: list[tuple[str, list[float]]]) -> str:
    """Shares in percent over years, stacked; a step for each year where there are few."""
    if not years:
        return empty(title)
    x = lambda i: 40 + 420 * (i / max(len(years) - 1, 1))
    below, body = [0.0] * len(years), []
    for j, (name, values) in enumerate(series):
        above = [a + b for a, b in zip(below, values, strict=True)]
        edge = [f"{x(i):.1f},{240 - 2 * v:.1f}" for i, v in enumerate(above)] + [f"{x(i):.1f},{240 - 2 * below[i]:.1f}" for i in reversed(range(len(years)))]
        body.append(f'<polygon points="{" ".join(edge)}" fill="{COLOURS[j % len(COLOURS)]}"><title>{escape(name)}</title></polygon>')
        body.append(_box(480, 40 + 16 * j, 10, 10, COLOURS[j % len(COLOURS)]) + _text(494, 49 + 16 * j, name))
        below = above
    body += [_text(x(i) - 12, 256, str(y)) for i, y in enumerate(years) if i % max(1, len(years) // 10) == 0]
    return _svg(max(270, 60 + 16 * len(series)), body, title)


def bubble_page(title: str, rows: list[dict], by: str, steps: dict[str, str]) -> str:
    """HTML with a bubble chart for each view, of which one is open; the hover text of a marker is its title."""
    out = [f"<h4>{escape(title)}</h4>"]
    views = sorted({r["view"] for r in rows}, key=lambda v: (v != "All", v))
    labels = sorted({r[by] for r in rows})
    place, column = {v: i for i, v in enumerate(labels)}, {s: i for i, s in enumerate(steps)}
    for view in views:
        body = [_text(160 + 110 * i, 36, s) for i, s in enumerate(steps.values())] + [_text(8, 70 + 64 * i, v[:24]) for v, i in place.items()]
        for r in (r for r in rows if r["view"] == view):
            x, y = 180 + 110 * column[r["from_phase"]], 66 + 64 * place[r[by]]
            body.append(f'<circle cx="{x}" cy="{y}" r="{r["size"] / 2:.1f}" fill="hsl({120 * r["rate"]:.0f},60%,60%)"><title>{escape(r["hover"])}</title></circle>')
        out.append(f'<details{" open" if view == "All" else ""}><summary>{escape(view)}</summary>{_svg(90 + 64 * len(labels), body, view)}</details>')
    return "".join(out)
