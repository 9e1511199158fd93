"""Scalar functions whose semantics Spark's built-ins don't have, as Column expressions and SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_UUID_SQL = (
    "concat(substr(lpad(hex(unix_millis(current_timestamp())), 12, '0'), 1, 8), '-', substr(lpad(hex(unix_millis(current_timestamp())), 12, '0'), 9, 4), "
    "'-7', substr(uuid(), 16, 3), '-', substr('89ab', 1 + cast(floor(rand() * 4) as int), 1), substr(uuid(), 21, 3), '-', substr(uuid(), 25, 12))"
)


def uuidv7() -> Column:
    """A time-ordered UUID, one a row."""
    return F.lower(F.expr(_UUID_SQL))


def register(spark: SparkSession) -> None:
    """UUIDV7(), UUID_V7() and scaled_round() for SQL text.

    scaled_round is half away from zero on x * 10**digits as a double, so 1.005 at 2 digits gives 1.0.
    """
    for name in ("uuidv7", "uuid_v7"):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}() RETURNS STRING NOT DETERMINISTIC RETURN lower({_UUID_SQL})")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION scaled_round(x DOUBLE, digits INT DEFAULT 0) RETURNS DOUBLE RETURN round(x * pow(10.0D, digits)) / pow(10.0D, digits)")
