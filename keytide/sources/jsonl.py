"""JSON-lines sink: append one object per report to a folder, or show them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from keytide.operators.json_report import as_json_lines


def write_reports(reports: DataFrame, path: str | None = None, mode: str = "append") -> None:
    """Write reports to ``path`` as JSON lines, by default after those there; without a path print them."""
    lines = as_json_lines(reports)
    if path:
        lines.write.mode(mode).text(path)
    else:
        lines.show(truncate=False)
