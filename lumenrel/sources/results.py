"""Result sinks: text tables, expanded records and JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cell(v) -> str:
    return "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)


def to_text(df: DataFrame, expanded: bool = False, limit: int = 1000) -> str:
    """The first ``limit`` rows for a terminal."""
    rows = [[_cell(v) for v in r] for r in df.limit(limit).collect()]
    names = df.columns
    if expanded:
        wide = max(map(len, names), default=0)
        return "\n".join(f"-[ RECORD {i} ]-\n" + "\n".join(f"{n.ljust(wide)} | {v}" for n, v in zip(names, r)) for i, r in enumerate(rows, 1)) + f"\n({len(rows)} rows)"
    wide = [max(len(n), *(len(r[i]) for r in rows)) if rows else len(n) for i, n in enumerate(names)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, wide)).rstrip()
    return "\n".join([line(names), "-+-".join("-" * w for w in wide), *map(line, rows), f"({len(rows)} rows)"])


def to_json_lines(df: DataFrame, stringify: bool = False) -> DataFrame:
    """A column ``json``; stringify makes every value a string, "NULL" for nulls."""
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")).alias(c) if stringify else F.col(f"`{c}`") for c in df.columns]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def to_objects(df: DataFrame, stringify: bool = False) -> list[dict]:
    return [json.loads(r["json"]) for r in to_json_lines(df, stringify).collect()]
