"""Report files, written from the small tables that reports consist of."""

from __future__ import annotations

import csv
import html
import math
import re
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from .readers import LABELS

Rows = list[dict]


def collected(frame: DataFrame, most: int = 100_000) -> Rows:
    """A report table's rows; a table that is none (more than `most` rows) is refused."""
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report table; write the frame instead")
    return [r.asDict() for r in rows]


def write_csv(rows: Rows, path: str) -> None:
    """Header from the first row, null as an empty field; nothing for no rows."""
    if rows:
        with open(path, "w", newline="", encoding="utf-8") as file:
            out = csv.DictWriter(file, list(rows[0]), extrasaction="ignore")
            out.writeheader()
            out.writerows(rows)


def write_state(rows: Rows, path: str) -> None:
    """The label file, as a whole, after every decision: its fixed columns whatever else the rows have."""
    names = [x.split()[0] for x in LABELS.split(", ")]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.DictWriter(file, names, extrasaction="ignore")
        out.writeheader()
        out.writerows(rows)


def write_sample(old: DataFrame, new: DataFrame, path: str) -> None:
    """The sampled pairs after those sampled before, as one CSV file; columns that one side lacks are empty."""
    names = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    rows = collected(old) + collected(new)
    write_csv([{c: r.get(c) for c in names} for r in rows], path)


def cell(value: object) -> str:
    if value is None:
        return "—"
    if isinstance(value, float):
        return f"{value:.1%}" if 0 <= value <= 1 else f"{value:.2f}"
    return str(value)


def html_table(rows: Rows) -> str:
    if not rows:
        return ""
    head = "".join(f"<th>{html.escape(k.replace('_', ' ').title())}</th>" for k in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{html.escape(cell(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def write_html(title: str, sections: list[tuple[str, str, Rows]], path: str) -> None:
    """A page with a table of contents; a section is (heading, text, table)."""
    toc = "".join(f'<li><a href="#s{i}">{html.escape(h)}</a></li>' for i, (h, _, _) in enumerate(sections))
    parts = "".join(f'<h2 id="s{i}">{html.escape(h)}</h2><p>{html.escape(t)}</p>{html_table(r)}' for i, (h, t, r) in enumerate(sections))
    Path(path).write_text(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{toc}</ul>{parts}</body></html>', encoding="utf-8")


def _sheet(rows: Rows) -> str:
    def one(value: object) -> str:
        if value is None or isinstance(value, float) and not math.isfinite(value):
            return "<c/>"
        if isinstance(value, int | float) and not isinstance(value, bool):
            return f"<c><v>{value!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = [list(rows[0])] + [list(r.values()) for r in rows] if rows else []
    data = "".join(f"<row>{''.join(map(one, x))}</row>" for x in lines)
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{data}</sheetData></worksheet>'


def write_xlsx(tables: dict[str, Rows], path: str) -> None:
    """A workbook with a sheet per table; names are cut to 31 characters, and those that a workbook may not have are spaces."""
    main, office = "http://schemas.openxmlformats.org", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = [re.sub(r"[\\/*?:\[\]]", " ", x)[:31] for x in tables]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        kinds = "".join(f'<Override PartName="/xl/worksheets/s{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
        out.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{main}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        out.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="r0" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(names))
        out.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}/spreadsheetml/2006/main" xmlns:r="{office}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(len(names)))
        out.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{main}/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(tables.values()):
            out.writestr(f"xl/worksheets/s{i}.xml", _sheet(rows))
