"""Sinks: CSV with fixed decimals, JSON bags, compressed Parquet, table sets with a deny list, templates."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv_fixed(df: DataFrame, path: str, decimals: int = 6, order: Sequence[str] = (), one_file: bool = False) -> None:
    """CSV with a header, unix newlines and doubles with a fixed number of decimals; ``one_file`` for results of a known small size."""
    doubles = {c for c, k in df.dtypes if k in ("double", "float")}
    out = df.orderBy(*order) if order else df
    out = out.select(*(F.format_string(f"%.{decimals}f", c).alias(c) if c in doubles else F.col(c) for c in df.columns))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "zstd") -> None:
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def to_json_bag(df: DataFrame) -> str:
    """A one-row frame of measures as JSON text."""
    return json.dumps(df.first().asDict(True), default=str, sort_keys=True)


def export(tables: dict[str, DataFrame], root: str, deny: Sequence[str] = (), prefix: str = "") -> list[str]:
    """Every table without the denied columns, the rest with a prefix; the paths written."""
    out = []
    for name, df in tables.items():
        kept = df.drop(*deny)
        kept.select(*(F.col(c).alias(prefix + c) for c in kept.columns)).write.mode("overwrite").parquet(path := f"{root}/{name}")
        out.append(path)
    return out


def fixed_width(rows: list[dict], columns: Sequence[str]) -> str:
    """A text table as wide as its longest values, numbers to the right."""
    cells = [[*columns]] + [["" if r[c] is None else str(r[c]) for c in columns] for r in rows]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    right = [bool(rows) and all(isinstance(r[c], (int, float)) for r in rows) for c in columns]
    return "\n".join("  ".join(x.rjust(w) if k else x.ljust(w) for x, w, k in zip(r, widths, right)).rstrip() for r in cells) + "\n"


def fill(template: str, values: dict) -> str:
    """``{{NAME}}`` marks replaced; one without a value is an error."""
    left = sorted({m for m in re.findall(r"\{\{([A-Z_0-9]+)\}\}", template) if m not in values})
    if left:
        raise KeyError(f"no value for {', '.join(left)}")
    return re.sub(r"\{\{([A-Z_0-9]+)\}\}", lambda m: str(values[m[1]]), template)
