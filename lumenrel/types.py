"""SQL type names and what they are in Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import ParseError


@dataclass(frozen=True)
class SqlType:
    name: str
    spark: str
    low: int | None = None
    high: int | None = None


_TYPES = {
    "BOOLEAN": SqlType("BOOLEAN", "boolean"),
    "SMALLINT": SqlType("SMALLINT", "smallint"),
    "U_SMALLINT": SqlType("U_SMALLINT", "int", 0, 2**16 - 1),
    "INT": SqlType("INTEGER", "int"),
    "INTEGER": SqlType("INTEGER", "int"),
    "U_INTEGER": SqlType("U_INTEGER", "bigint", 0, 2**32 - 1),
    "BIGINT": SqlType("BIGINT", "bigint"),
    "U_BIGINT": SqlType("U_BIGINT", "decimal(20,0)", 0, 2**64 - 1),
    "REAL": SqlType("REAL", "float"),
    "DOUBLE": SqlType("DOUBLE", "double"),
    "FLOAT": SqlType("DOUBLE", "double"),
    "VARCHAR": SqlType("VARCHAR", "string"),
    "CHAR": SqlType("CHAR", "string"),
    "TEXT": SqlType("TEXT", "string"),
    "DATE": SqlType("DATE", "date"),
    "TIME": SqlType("TIME", "string"),
    "TIMESTAMP": SqlType("TIMESTAMP", "timestamp_ntz"),
    "UUID": SqlType("UUID", "string"),
    "UUIDV7": SqlType("UUIDV7", "string"),
}
_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-([0-9a-fA-F])[0-9a-fA-F]{3}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def sql_type(text: str) -> SqlType:
    name = re.sub(r"\(.*", "", text.strip()).strip().upper()
    name = {"DOUBLE PRECISION": "DOUBLE", "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP", "TIMESTAMP WITH TIME ZONE": "TIMESTAMP"}.get(name, name)
    if name not in _TYPES:
        raise ParseError(f"unsupported SQL type: {text}")
    return _TYPES[name]


def store(col: Column, kind: SqlType) -> Column:
    """ANSI store assignment: lossy or out-of-range values raise."""
    out = col.cast(kind.spark)
    bad = None
    if kind.low is not None:
        bad = (out < kind.low) | (out > F.lit(kind.high).cast("decimal(20,0)"))
    elif kind.name == "UUID":
        bad = ~out.rlike(_UUID)
    elif kind.name == "UUIDV7":
        bad = ~out.rlike(_UUID.replace("([0-9a-fA-F])", "7"))
    elif kind.name == "TIME":
        bad = ~out.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?$")
    if bad is None:
        return out
    return F.when(out.isNull() | ~bad, out).otherwise(F.raise_error(F.concat(F.lit(f"value out of range for {kind.name}: "), out.cast("string"))))
