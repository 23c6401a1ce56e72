"""Small Markdown reports: figures are formatted by Spark, and only the rows shown reach the driver."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(c, 0)), F.lit("n/a"))


def fixed(c: Column, places: int) -> Column:
    return F.coalesce(F.format_string(f"%.{places}f", c.cast("double")), F.lit("n/a"))


def table(df: DataFrame, rows: int) -> str:
    """The first ``rows`` rows of an ordered table; bars and line ends in cells are escaped."""
    cells = [F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ").alias(c) for c in df.columns]
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in df.select(cells).limit(rows).collect()])


def report(title: str, sections: dict[str, str]) -> str:
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n{body}" for name, body in sections.items()]]) + "\n"


def write(text: str, path: str) -> None:
    """Readers see the old file or the whole new one."""
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise
