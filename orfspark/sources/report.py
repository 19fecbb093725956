"""The HTML report: tables and bar charts as inline SVG, from the small results of the report queries."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence
from string import Template

#: Colours of reading frames 0, 1 and 2, and of a single series.
FRAMES, PLAIN = ("#3b6ea8", "#c8643c", "#5c9a5c"), "#5b6b7b"

_PAGE = Template("""<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>$title</title>
<style>
body { font-family: sans-serif; margin: 2em; color: #222 } table { border-collapse: collapse } td, th { border: 1px solid #ccc; padding: .25em .6em; text-align: right }
td:first-child, th:first-child { text-align: left } details { margin: 1em 0 } summary { font-weight: bold; cursor: pointer } svg { display: block; margin: .6em 0 1.4em }
</style></head><body><h1>$title</h1>
$sections
</body></html>
""")


def parameters_used(given: Mapping[str, object]) -> dict[str, object]:
    """The parameters that have a value."""
    return {k: v for k, v in given.items() if v is not None}


def table(rows: Sequence[Mapping[str, object]], columns: Sequence[str]) -> str:
    cell = lambda v: html.escape(f"{v:.2f}" if isinstance(v, float) else "" if v is None else str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def bars(points: Sequence[tuple[float, float, str]], title: str, width: int = 720, height: int = 160) -> str:
    """A bar chart of (x, value, colour)."""
    if not points:
        return f"<p>{html.escape(title)}: no reads</p>"
    low, high = min(p[0] for p in points), max(p[0] for p in points)
    top = max([p[1] for p in points if p[1] > 0], default=1)
    step = width / (high - low + 1)
    drawn = "".join(f'<rect x="{(x - low) * step:.2f}" y="{height - height * max(v, 0) / top:.2f}" width="{max(step * 0.9, 0.5):.2f}" height="{height * max(v, 0) / top:.2f}" fill="{c}"><title>{x:g}: {v:g}</title></rect>' for x, v, c in points)
    axis = f'<text x="0" y="{height + 14}" font-size="11">{low:g}</text><text x="{width}" y="{height + 14}" font-size="11" text-anchor="end">{high:g}</text><text x="{width}" y="10" font-size="11" text-anchor="end">{top:g}</text>'
    return f'<figure><figcaption>{html.escape(title)}</figcaption><svg viewBox="0 0 {width} {height + 18}" width="{width}">{drawn}{axis}</svg></figure>'


def render(
    parameters: Mapping[str, object], top: Sequence[Mapping[str, object]], metagene: Mapping[tuple[str, str], Sequence[tuple[int, float]]],
    profiles: Mapping[str, Sequence[tuple[int, int, float]]], title: str = "Open reading frames",
) -> str:
    """The page: parameters, best ORFs, metagene charts by (type, anchor), coverage by transcript as (position, frame, counts)."""
    columns = ("type", "rank", "tran_id", "start", "stop", "length", "startorf", "stoporf", "rise_up", "step_down", "hrf", "avg", "nzc", "score")
    summary = [(i, float(r["score"] or 0), FRAMES[i % 3]) for i, r in enumerate(top)]
    sections = [
        ("Parameters", table([{"parameter": k, "value": v} for k, v in parameters_used(parameters).items()], ("parameter", "value"))),
        ("Best ORFs by type", table(top, columns) + bars(summary, "scores in the order of the table")),
        ("Metagene profiles", "".join(bars([(x, v, FRAMES[x % 3]) for x, v in points], f"{kind}, by distance from the {anchor}") for (kind, anchor), points in metagene.items())),
        ("Transcripts", "".join(bars([(x, v, FRAMES[f]) for x, f, v in points], name) for name, points in profiles.items())),
    ]
    return _PAGE.substitute(title=html.escape(title), sections="\n".join(f"<details open><summary>{t}</summary>{body}</details>" for t, body in sections))
