"""JSON queries compiled to DataFrame plans: find, create, update, delete and upsert, with nested includes."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParseError

_COMPARE = {
    "eq": lambda c, v: c.isNull() if v is None else c == v,
    "ne": lambda c, v: c.isNotNull() if v is None else c != v,
    "not": lambda c, v: c.isNotNull() if v is None else c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "contains": lambda c, v: c.contains(v),
    "startsWith": lambda c, v: c.startswith(v),
    "endsWith": lambda c, v: c.endswith(v),
    "in": lambda c, v: c.isin(list(v)),
}


def predicate(where: dict[str, Any], columns: list[str]) -> Column:
    """All keys hold; AND and OR take lists, NOT an object. An unknown column selects nothing."""
    names = {c.lower(): c for c in columns}
    out = F.lit(True)
    for key, value in where.items():
        if key == "AND":
            for w in value if isinstance(value, list) else [value]:
                out = out & predicate(w, columns)
        elif key == "OR":
            some = F.lit(False)
            for w in value:
                some = some | predicate(w, columns)
            out = out & some
        elif key == "NOT":
            out = out & ~predicate(value, columns)
        elif key.lower() not in names:
            out = out & F.lit(False)
        else:
            col = F.col(f"`{names[key.lower()]}`")
            if isinstance(value, dict):
                for op, v in value.items():
                    if op not in _COMPARE:
                        raise ParseError(f"unknown operator {op}")
                    out = out & _COMPARE[op](col, v)
            elif isinstance(value, list):
                out = out & col.isin(value)
            else:
                out = out & _COMPARE["eq"](col, value)
    return out


def ordering(order: Any, columns: list[str]) -> list[Column]:
    """NULLs are the largest."""
    items = order if isinstance(order, list) else [order]
    out = []
    for item in items:
        for name, way in item.items():
            if name in columns:
                out.append(F.col(f"`{name}`").desc_nulls_first() if str(way).lower() == "desc" else F.col(f"`{name}`").asc_nulls_last())
    return out


def find_many(query: dict[str, Any], tables: Any, relation: Any) -> DataFrame:
    """tables(name) gives a frame, relation(parent, child) the pair (parent column, child column) that joins them."""
    name = query["from"]
    frame = tables(name)
    columns = frame.columns
    if query.get("where"):
        frame = frame.filter(predicate(query["where"], columns))
    order = ordering(query["orderBy"], columns) if query.get("orderBy") else []
    paged = frame.orderBy(*order) if order else frame
    if query.get("skip"):
        paged = paged.offset(int(query["skip"]))
    if query.get("take") is not None:
        paged = paged.limit(int(query["take"]))
    chosen = [c for c in columns if not query.get("select") or query["select"].get(c)]
    if not query.get("include"):
        return paged.select(*(f"`{c}`" for c in chosen))
    included = []
    for child, options in query["include"].items():
        options = options if isinstance(options, dict) else {}
        up, down = relation(name, child)
        rows = tables(child)
        if options.get("where"):
            rows = rows.filter(predicate(options["where"], rows.columns))
        shown = [c for c in rows.columns if not options.get("select") or options["select"].get(c)]
        keys = ordering(options["orderBy"], rows.columns) if options.get("orderBy") else [F.col(f"`{down}`")]
        from pyspark.sql import Window

        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(f"`{down}`").orderBy(*keys)))
        if options.get("take") is not None:
            rows = rows.filter(F.col("__n") <= int(options["take"]))
        packed = rows.groupBy(F.col(f"`{down}`").alias(f"__{child}")).agg(F.sort_array(F.collect_list(F.struct("__n", F.struct(*(f"`{c}`" for c in shown)).alias("row")))).alias("__rows"))
        packed = packed.select(f"__{child}", F.transform("__rows", lambda x: x["row"]).alias(child))
        paged = paged.join(packed, paged[f"`{up}`"] == packed[f"__{child}"], "left").drop(f"__{child}").withColumn(child, F.coalesce(F.col(child), F.array()))
        included.append(child)
    if order:
        paged = paged.orderBy(*order)
    return paged.select(*(f"`{c}`" for c in [*chosen, *included]))


def literal(value: Any) -> str:
    """A JSON value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, int):
        return repr(value)
    if isinstance(value, Decimal):
        return f"CAST('{value}' AS DECIMAL({max(len(value.as_tuple().digits), -value.as_tuple().exponent, 1)},{max(0, -value.as_tuple().exponent)}))"
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "''") + "'"


def predicate_sql(where: dict[str, Any], columns: list[str]) -> str:
    """The same predicate as SQL text, for changes."""
    names = {c.lower(): c for c in columns}
    parts = []
    like = lambda c, a, v, z: f"{a}({c}, {literal(v)}){z}"
    for key, value in where.items():
        if key == "AND":
            parts += [predicate_sql(w, columns) for w in (value if isinstance(value, list) else [value])]
        elif key == "OR":
            parts.append("(" + (" OR ".join(predicate_sql(w, columns) for w in value) or "FALSE") + ")")
        elif key == "NOT":
            parts.append(f"NOT ({predicate_sql(value, columns)})")
        elif key.lower() not in names:
            parts.append("FALSE")
        else:
            c = f"`{names[key.lower()]}`"
            tests = value if isinstance(value, dict) else {"in": value} if isinstance(value, list) else {"eq": value}
            for op, v in tests.items():
                if op in ("eq", "ne", "not"):
                    parts.append(f"{c} IS {'' if op == 'eq' else 'NOT '}NULL" if v is None else f"{c} {'=' if op == 'eq' else '<>'} {literal(v)}")
                elif op in ("gt", "gte", "lt", "lte"):
                    parts.append(f"{c} {dict(gt='>', gte='>=', lt='<', lte='<=')[op]} {literal(v)}")
                elif op in ("contains", "startsWith", "endsWith"):
                    parts.append(like(c, op.lower(), v, ""))
                elif op == "in":
                    parts.append(f"{c} IN ({', '.join(map(literal, v))})" if v else "FALSE")
                else:
                    raise ParseError(f"unknown operator {op}")
    return " AND ".join(f"({p})" for p in parts) or "TRUE"
