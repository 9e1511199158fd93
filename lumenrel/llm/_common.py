"""Helpers that the operators share: the shared scratch folder, hot-group joins, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts; everything else belongs to words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        found = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        local = tempfile.mkdtemp(prefix="lumenrel-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end_with_query(spark: SparkSession) -> Iterator[None]:
    """Spark deletes a query's shuffle files when the query ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage at a table that outlives executors.

    The written table replaces the query's shuffle files, which go at once; until the write ends they serve retries as ever.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_end_with_query(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def discard(df: DataFrame) -> None:
    """Deletes a table of materialise() that nothing will read again."""
    remove(df.sparkSession, df._scratch)


def open_store(uri: str):
    """(pyarrow filesystem, path) for a URI that every executor reaches: file, hdfs, s3 or gs."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    scheme = {"s3a": "s3", "s3n": "s3"}.get(parsed.scheme, parsed.scheme)
    return fs.FileSystem.from_uri(f"{scheme}{uri[len(parsed.scheme):]}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: str | Column) -> Column:
    """Number of words as the contracts define them; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(col) if isinstance(col, str) else col, F.lit(WORD)), F.lit(0)).cast("long")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "left", hot_share: int = 1000, least: int = 100) -> DataFrame:
    """Join ``groups`` (one row a key, column ``size`` = its rows in ``rows``) to ``rows``, left or inner; hot keys are split off.

    A key is hot when it holds over total/hot_share rows (``least`` at least); so there are under
    hot_share hot keys whatever the input is, which bounds what is broadcast and what the driver gets. Other keys shuffle, and none of their
    groups is large. ``groups`` should come from a materialised table since it is read up to four times.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(least, total // hot_share)
    extra = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) > limit)
    keys = [r[0] for r in hot.select(key).collect()]  # under hot_share
    if not keys:
        return rows.join(groups, key, how).select(*rows.columns, *extra)
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    done = rows.filter(is_hot).join(F.broadcast(hot), key).select(*rows.columns, *extra)
    rest = rows.filter(~is_hot).join(groups.filter(F.col(size) <= limit), key, how).select(*rows.columns, *extra)
    return done.unionByName(rest)


class Tables:
    """Tables of materialise() that belong together, to delete what nothing will read again."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def make(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(materialise(df, name))
        return self.made[-1]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            discard(t)
            self.made = [x for x in self.made if x is not t]

    def drop_but(self, *tables: DataFrame) -> None:
        self.drop(*(t for t in self.made if not any(t is x for x in tables)))


def quoted(name: str) -> Column:
    """The column of this very name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while f"__{name}".lower() in taken:
            name += "_"
        out.append(f"__{name}")
    return out


def text_key(text: str | Column) -> Column:
    """128 bits that tell texts apart; null is as empty."""
    return F.unhex(F.md5(F.encode(blank(text), "UTF-8")))


def components(nodes_edges: DataFrame, name: str = "cc") -> tuple[DataFrame, DataFrame]:
    """(rows, table they are read from): connected components of edges (a long, b long): rows (node, component) for each node with an edge; component = smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014), a round of both a table in the shared folder. A step reads its edges twice, so
    a round's plan has few nodes; the driver's memory grows with the plans, not with the edges. Edges never come to the driver; the loop ends when they are stars.
    """
    edges = nodes_edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    stored = None

    def pairs(rows: DataFrame, *of: tuple[str, str]) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in of))).alias("x")
        return rows.select(each).select("x.u", "x.v").filter("u <> v")

    def large(e: DataFrame) -> DataFrame:
        both = pairs(e, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        return pairs(e.join(least, "u"), ("v", "m"), ("u", "m")).distinct()

    def stars(e: DataFrame) -> bool:
        """Whether each node is the end of one edge, or the least end of some."""
        ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x")
        seen = e.select(ends).groupBy("x.node").agg(F.sum("x.up").alias("up"), F.min("x.up").alias("least"))
        return seen.filter("up > 1 or (up > 0 and least = 0)").isEmpty()

    while stored is None or not stars(stored):
        before, stored = stored, materialise(small(large(edges if stored is None else stored)), name)
        if before is not None:
            discard(before)
    roots = stored.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stored.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), stored
