"""Reports from small result tables: text, HTML and SVG, made on the driver and written through Spark's file systems."""

from __future__ import annotations

import colorsys
import json
import math
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.operators import kernels
from simlattice.operators.structure import collected


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file of text, over whatever is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def colours(names: list[str]) -> dict[str, str]:
    """A colour for each name: hues are spread evenly."""
    hue = lambda k: colorsys.hls_to_rgb(k / max(1, len(names)), 0.45, 0.6)
    return {n: "#" + "".join(f"{round(255 * c):02x}" for c in hue(k)) for k, n in enumerate(sorted(names))}


def _svg(width: float, height: float, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height:.0f}" viewBox="0 0 {width:.0f} {height:.0f}">{"".join(parts)}</svg>'


def _line(x1: float, y1: float, x2: float, y2: float, colour: str = "#667") -> str:
    return f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" stroke="{colour}"/>'


def _label(x: float, y: float, text: str, colour: str = "#223") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="10" fill="{colour}">{escape(text)}</text>'


def legend(colour: dict[str, str], x: float = 8, y: float = 14) -> list[str]:
    return [part for k, (n, c) in enumerate(colour.items()) for part in (f'<rect x="{x:.0f}" y="{y + 14 * k - 8:.0f}" width="9" height="9" fill="{c}"/>', _label(x + 14, y + 14 * k, n))]


def tree_svg(tree: kernels.Tree, source: dict[str, str] | None = None, width: float = 900, row: float = 12) -> str:
    """A tree from left to right, tips coloured by source."""
    place = {n: (d, h) for n, d, h in kernels.layout(tree)}
    far = max((d for d, _ in place.values()), default=1.0) or 1.0
    at = lambda n: (10 + place[n][0] / far * (width - 260), 16 + place[n][1] * row)
    colour = colours(sorted(set((source or {}).values())))
    parts = []
    for n, up, _, name in tree:
        x, y = at(n)
        if up is not None:
            ux, uy = at(up)
            parts += [_line(ux, uy, ux, y), _line(ux, y, x, y)]
        if name is not None:
            parts.append(_label(x + 4, y + 3, name, colour.get((source or {}).get(name, ""), "#223")))
    tips = sum(t[3] is not None for t in tree)
    return _svg(width, 32 + row * tips, parts)


def radial_svg(tree: kernels.Tree, source: dict[str, str] | None = None, size: float = 900) -> str:
    """A tree around its root: tips share the circle evenly, depth is the radius."""
    place = {n: (d, h) for n, d, h in kernels.layout(tree)}
    tips = max(1, sum(t[3] is not None for t in tree))
    far = max((d for d, _ in place.values()), default=1.0) or 1.0
    colour = colours(sorted(set((source or {}).values())))

    def at(n: int) -> tuple[float, float]:
        r, angle = place[n][0] / far * (size / 2 - 20), 2 * math.pi * place[n][1] / tips
        return size / 2 + r * math.cos(angle), size / 2 + r * math.sin(angle)

    parts = []
    for n, up, _, name in tree:
        if up is not None:
            parts.append(_line(*at(up), *at(n)))
        if name is not None:
            x, y = at(n)
            parts.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3" fill="{colour.get((source or {}).get(name, ""), "#223")}"><title>{escape(name)}</title></circle>')
    return _svg(size, size, [*parts, *legend(colour)])


def ranking_svg(rows: list[dict], value: str = "pass_rate", low: str = "wilson_low", high: str = "wilson_high", width: float = 720, row: float = 20) -> str:
    """Points with intervals, one row for each entrant."""
    ends = [r[k] for r in rows for k in (value, low, high) if r.get(k) is not None]
    lo, hi = (min(ends), max(ends)) if ends else (0.0, 1.0)
    x = lambda v: 220 + (v - lo) / ((hi - lo) or 1.0) * (width - 300)
    parts = []
    for k, r in enumerate(rows):
        y = 20 + k * row
        parts.append(_label(6, y + 4, str(r["agent_id"])))
        if r.get(value) is None:
            continue
        if r.get(low) is not None and r.get(high) is not None:
            parts.append(_line(x(r[low]), y, x(r[high]), y))
        parts += [f'<circle cx="{x(r[value]):.1f}" cy="{y:.1f}" r="4" fill="#0a5d94"/>', _label(width - 70, y + 4, f"{r[value]:.3f}")]
    return _svg(width, 40 + row * len(rows), parts)


def html_table(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    head = "".join(f"<th>{escape(str(c))}</th>" for c in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def html_page(title: str, sections: dict[str, str]) -> str:
    body = "".join(f"<h2>{escape(name)}</h2>{html}" for name, html in sections.items())
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{body}</body></html>'


def small(df: DataFrame, most: int = 5000) -> list[dict]:
    """Rows of a result that a page shows; more than `most` are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report shows at most {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def write_tree_outputs(spark: SparkSession, folder: str, tree: DataFrame, pairs: DataFrame, distances: DataFrame, clusters: DataFrame | None = None, title: str = "Tree") -> None:
    """tree.nwk, pairs.json, report.html, and the distances as a folder of CSV with four decimals."""
    own = collected(tree)
    write_text(spark, kernels.newick(own) + "\n", f"{folder}/tree.nwk")
    rows = small(pairs)
    write_text(spark, json.dumps(rows, indent=2, sort_keys=True), f"{folder}/pairs.json")
    sections = {"Tree": tree_svg(own), "Nearest pairs": html_table(rows)}
    if clusters is not None:
        by = clusters.groupBy("label").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("members")).orderBy(F.desc("size"), "label")
        sections["Clusters"] = html_table(small(by))
    write_text(spark, html_page(title, sections), f"{folder}/report.html")
    distances.select("i", "j", F.format_number("d", 4).alias("d")).write.mode("overwrite").option("header", "true").csv(f"{folder}/distances")


def markdown_report(title: str, facts: dict[str, object], tables: dict[str, list[dict]]) -> str:
    lines = [f"# {title}", "", *[f"- {k}: {v}" for k, v in facts.items()]]
    for name, rows in tables.items():
        lines += ["", f"## {name}", ""]
        if rows:
            lines += ["| " + " | ".join(rows[0]) + " |", "| " + " | ".join("---" for _ in rows[0]) + " |", *["| " + " | ".join(str(v) for v in r.values()) + " |" for r in rows]]
    return "\n".join(lines) + "\n"
