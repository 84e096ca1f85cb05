"""Sinks: JSON lines, CSV, parquet, append logs, and small reports as Markdown and SVG."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a report may have: it is formatted by the driver.
REPORT_ROWS = 10_000


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; non-ASCII text is kept as it is, null fields are left out."""
    df.write.mode(mode).json(path)


def csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV with a header, quotes doubled; an empty table has no header, as it has no files with rows."""
    (df.select(*columns) if columns else df).write.mode(mode).csv(path, header=True, quote='"', escape='"')


def parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log; a failed write leaves the log as it was."""
    df.write.mode("append").parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on whatever storage the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def manifest(spark: SparkSession, path: str, values: dict) -> None:
    """A small JSON file."""
    write_text(spark, path, json.dumps(values, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def vocabulary_file(vocab: DataFrame, path: str, most: int = 1_000_000) -> None:
    """{token: id} as one JSON file, in the order of ids; a larger vocabulary is kept as a table instead."""
    rows = vocab.select("token", "token_id").orderBy("token_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary file has at most {most} tokens; write a table")
    write_text(vocab.sparkSession, path, json.dumps({r[0]: r[1] for r in rows}, ensure_ascii=False, indent=1) + "\n")


def _small(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows; aggregate first")
    return rows


def _cell(v) -> str:
    return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame) -> str:
    """A Markdown table; floats have four places."""
    rows = _small(df)
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(map(_cell, r)) + " |" for r in rows)]) + "\n"


def markdown_report(spark: SparkSession, path: str, title: str, parts: list[tuple[str, DataFrame | str]]) -> None:
    """A report of headed tables and texts."""
    text = f"# {title}\n" + "".join(f"\n## {head}\n\n{body if isinstance(body, str) else markdown_table(body)}" for head, body in parts)
    write_text(spark, path, text)


def evaluation_report(spark: SparkSession, path: str, title: str, setup: dict, summary: DataFrame, curves: DataFrame | None = None, counters: dict | None = None) -> None:
    """The report of an evaluation: its setup and row counters as a list, then its summary and curves as tables."""
    listed = "".join(f"- {k}: `{v}`\n" for k, v in {**setup, **(counters or {})}.items())
    parts: list[tuple[str, DataFrame | str]] = [("Setup", listed), ("Summary", summary)]
    markdown_report(spark, path, title, parts + ([("Curves", curves)] if curves is not None else []))


def benchmark_report(spark: SparkSession, path: str, title: str, rows: DataFrame, by: str = "topic") -> None:
    """The report of a benchmark: its size, and rows and references per ``by``."""
    size = F.size("references")
    per = rows.groupBy(by).agg(F.count("*").alias("rows"), F.sum(size).alias("references"), F.max(size).alias("most_references")).orderBy(by)
    markdown_report(spark, path, title, [("Size", f"- rows: `{rows.count()}`\n"), (by.capitalize(), per)])


def stability_report(spark: SparkSession, path: str, title: str, summary: DataFrame, groups: DataFrame) -> None:
    """The report of a stability evaluation: means per model, then the least stable groups."""
    markdown_report(spark, path, title, [("Means", summary), ("Least stable groups", groups.orderBy("stability").limit(50))])


# Line colours.
COLOURS = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#ff7f0e", "#17becf", "#8c564b", "#7f7f7f")


def svg_lines(df: DataFrame, x: str, y: str, series: str, title: str, width: int = 720, height: int = 420) -> str:
    """A line chart of collected curves, one line per series; y is clamped to [0, 1]."""
    lines: dict[str, list[tuple[float, float]]] = {}
    for r in _small(df.select(series, x, y).orderBy(series, x)):
        if r[1] is not None and r[2] is not None:
            lines.setdefault(str(r[0]), []).append((float(r[1]), min(1.0, max(0.0, float(r[2])))))
    xs = [p[0] for pts in lines.values() for p in pts] or [0.0, 1.0]
    low, span = min(xs), (max(xs) - min(xs)) or 1.0
    left, top, right, bottom = 50, 40, width - 160, height - 40
    at = lambda p: (left + (p[0] - low) / span * (right - left), bottom - p[1] * (bottom - top))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">', f'<text x="{left}" y="22" font-size="15">{html.escape(title)}</text>']
    for k in range(6):
        yy = bottom - k / 5 * (bottom - top)
        out.append(f'<line x1="{left}" y1="{yy:.1f}" x2="{right}" y2="{yy:.1f}" stroke="#ddd"/><text x="{left - 8}" y="{yy + 4:.1f}" text-anchor="end">{k / 5:.1f}</text>')
    for v in sorted(set(xs))[:40]:
        out.append(f'<text x="{at((v, 0))[0]:.1f}" y="{bottom + 18}" text-anchor="middle">{v:g}</text>')
    for k, (name, pts) in enumerate(sorted(lines.items())):
        colour = COLOURS[k % len(COLOURS)]
        out.append(f'<polyline fill="none" stroke="{colour}" stroke-width="2" points="{" ".join(f"{a:.1f},{b:.1f}" for a, b in map(at, pts))}"/>')
        out.append(f'<text x="{right + 12}" y="{top + 18 * k + 4}" fill="{colour}">{html.escape(name)}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"


def svg_file(spark: SparkSession, path: str, text: str) -> None:
    write_text(spark, path, text)
