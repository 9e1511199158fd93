"""Changes to stored tables: staged by statement, checked and published by a transaction."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ColumnNotFound, Conflict, DuplicateKey, NullViolation
from ..sources.store import HIDDEN, Manifest, TableStore
from ..types import sql_type, store


@dataclass
class Change:
    """kind insert (rows), update (assignments) or delete; where: a SQL predicate; ids: what it touched, as Parquet files."""

    kind: str
    rows: DataFrame | None = None
    assignments: dict[str, str] | None = None
    where: str | None = None
    ids: list[str] | None = None
    files: list[str] | None = None


class Transaction:
    """Snapshot reads and optimistic commit of the tables of one store."""

    def __init__(self, tables: TableStore):
        self.tables, self.spark, self.id = tables, tables.spark, uuid.uuid4().hex
        self.base: dict[str, int] = {}
        self.staged: dict[str, Manifest] = {}
        self.changes: dict[str, list[Change]] = {}
        self.inserted: dict[str, int] = {}

    def manifest(self, table: str) -> Manifest:
        if table not in self.staged:
            self.base[table] = self.tables.version(table)
            self.staged[table] = self.tables.manifest(table, self.base[table])
        return self.staged[table]

    def frame(self, table: str) -> DataFrame:
        return self.tables.read(table, self.manifest(table))

    def rows(self, table: str) -> DataFrame:
        """What a query sees."""
        return self.tables.ordered(self.frame(table), self.manifest(table)).drop(*HIDDEN)

    def insert(self, table: str, values: DataFrame, columns: list[str] | None = None) -> int:
        m = self.manifest(table)
        names = columns or [c.name for c in m.columns]
        if len(names) != len(values.columns):
            raise ColumnNotFound(f"{table}: {len(names)} columns, {len(values.columns)} values")
        for n in names:
            if not m.column(n):
                raise ColumnNotFound(f"{table}.{n}")
        given = {n.lower(): F.col(f"_c{i}") for i, n in enumerate(names)}
        frame = values.toDF(*(f"_c{i}" for i in range(len(names))))
        out = [store(given.get(c.name.lower(), F.expr(c.default) if c.default is not None else F.lit(None)), sql_type(c.type)).alias(c.name) for c in m.columns]
        start = self.inserted.get(table, 0)
        frame = frame.select(*out, F.lit(self.id).alias("_txn"), (F.monotonically_increasing_id() + start).alias("_ord"))
        files = self.tables.write(table, frame)
        written = self.spark.read.schema(m.schema).parquet(*files) if files else frame.limit(0)
        self._not_null(m, written, table)
        stat = written.agg(F.count("*").alias("n"), F.max("_ord").alias("last")).first()
        self.inserted[table] = (stat["last"] if stat["last"] is not None else start - 1) + 1
        m.files = [*m.files, *files]
        m.txns = {**m.txns, self.id: m.txns.get(self.id, len(m.txns))}
        self.changes.setdefault(table, []).append(Change("insert", files=files))
        return stat["n"]

    def update(self, table: str, assignments: dict[str, str], where: str | None = None) -> int:
        m = self.manifest(table)
        for name in assignments:
            if not m.column(name):
                raise ColumnNotFound(f"{table}.{name}")
        return self._rewrite(table, Change("update", assignments=assignments, where=where))

    def delete(self, table: str, where: str | None = None) -> int:
        return self._rewrite(table, Change("delete", where=where))

    def _rewrite(self, table: str, change: Change) -> int:
        m = self.manifest(table)
        frame = self.frame(table)
        hit = F.coalesce(F.expr(change.where), F.lit(False)) if change.where else F.lit(True)
        if not m.files:
            frame.filter(hit).isEmpty()  # resolves the names
            return 0
        found = self.spark.read.schema(m.schema).parquet(*m.files).alias(table)
        ids = found.filter(hit).select(*HIDDEN, F.col("_metadata.file_path").alias("file"))
        change.ids = self.tables.write(table, ids, "touched")
        read = self.spark.read.schema("_txn string, _ord bigint, file string").parquet(*change.ids) if change.ids else ids.limit(0)
        n = read.count()
        if n:
            self._apply(table, change, hit, [r["file"] for r in read.select("file").distinct().collect()])
            m.touched = [*m.touched, *change.ids]
            self.changes.setdefault(table, []).append(change)
        return n

    def _apply(self, table: str, change: Change, hit: Column, files: list[str]) -> None:
        """Rewrites only the files that hold rows to change."""
        m = self.staged[table]
        plain = {f.replace("file:///", "/").replace("file:/", "/"): f for f in m.files}
        old = [plain[f.replace("file:///", "/").replace("file:/", "/")] for f in files]
        part = self.spark.read.schema(m.schema).parquet(*old).alias(table)
        if change.kind == "delete":
            new = part.filter(~hit)
        else:
            lower = {k.lower(): v for k, v in change.assignments.items()}
            columns = [
                F.when(hit, store(F.expr(lower[c.name.lower()]), sql_type(c.type))).otherwise(F.col(c.name)).alias(c.name) if c.name.lower() in lower else F.col(c.name) for c in m.columns
            ]
            new = part.select(*columns, *HIDDEN)
        written = self.tables.write(table, new)
        if change.kind == "update" and written:
            self._not_null(m, self.spark.read.schema(m.schema).parquet(*written), table)
        m.files = [f for f in m.files if f not in set(old)] + written

    def _not_null(self, m: Manifest, rows: DataFrame, table: str) -> None:
        keyed = {c.lower() for name, i in m.indexes.items() if name == f"pk_{table}" for c in i["columns"]}
        for c in m.columns:
            if (not c.nullable or c.name.lower() in keyed) and not rows.filter(F.col(c.name).isNull()).isEmpty():
                raise NullViolation(f"{table}.{c.name}")

    def check_unique(self, table: str, m: Manifest, checked: list[str] = ()) -> None:
        """Raises for keys that occur twice; those that are null throughout are exempt. checked: files whose rows are known to differ among themselves."""
        old = [f for f in m.files if f in set(checked)]
        new = [f for f in m.files if f not in set(checked)]
        if not new:
            return
        read = lambda files: self.spark.read.schema(m.schema).parquet(*files)
        for name, index in m.indexes.items():
            if index["unique"]:
                keys = index["columns"]
                some = F.coalesce(*(F.col(c).cast("string") for c in keys)).isNotNull()
                batch = read(new).filter(some).groupBy(*keys).count()
                twice = not batch.filter("count > 1").isEmpty()
                if not twice and old:
                    former, own = read(old).alias("o"), batch.alias("n")
                    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in keys]
                    twice = not former.join(own, same, "left_semi").isEmpty()
                if twice:
                    raise DuplicateKey(f"{name} on {table}({', '.join(keys)})")

    def _may_break_keys(self, m: Manifest, changes: list[Change]) -> bool:
        keyed = {c.lower() for i in m.indexes.values() if i["unique"] for c in i["columns"]}
        return any(c.kind == "insert" or c.kind == "update" and keyed & {k.lower() for k in c.assignments} for c in changes)

    def commit(self) -> None:
        """All tables are checked against their newest versions, then published in one commit; if another was first, again."""
        while self.changes:
            for table, changes in self.changes.items():
                newest = self.tables.version(table)
                if newest > self.base[table]:
                    self._rebase(table, newest, changes)
                m = self.staged[table]
                if self._may_break_keys(m, changes):
                    self.check_unique(table, m, self.tables.manifest(table, newest).files)
                m.version = newest + 1
                m.touched = [f for c in changes for f in (c.ids or [])]
                m.renumbered = False
            if self.tables.publish_all({t: self.staged[t] for t in self.changes}):
                break
        self.rollback()

    def _rebase(self, table: str, newest: int, changes: list[Change]) -> None:
        """Onto the newest version: rows that both sides touched conflict, others are changed there anew."""
        ours = [f for c in changes for f in (c.ids or [])]
        between = [self.tables.manifest(table, v) for v in range(self.base[table] + 1, newest + 1)]
        if ours and any(m.renumbered for m in between):
            raise Conflict(f"{table} was compacted since version {self.base[table]}")
        theirs = [f for m in between for f in m.touched]
        if ours and theirs:
            read = lambda files: self.spark.read.schema("_txn string, _ord bigint").parquet(*files)
            if not read(ours).join(read(theirs), HIDDEN, "left_semi").isEmpty():
                raise Conflict(f"{table} changed since version {self.base[table]}")
        m = self.tables.manifest(table, newest)
        self.staged[table], self.base[table] = m, newest
        for c in changes:
            if c.kind == "insert":
                m.files = [*m.files, *c.files]
                m.txns = {**m.txns, self.id: m.txns.get(self.id, len(m.txns))}
            else:
                ids = self.spark.read.schema("_txn string, _ord bigint").parquet(*c.ids)
                frame = self.spark.read.schema(m.schema).parquet(*m.files)
                files = [r["file"] for r in frame.select(*HIDDEN, F.col("_metadata.file_path").alias("file")).join(ids, HIDDEN, "left_semi").select("file").distinct().collect()]
                if files:
                    hit = F.coalesce(F.expr(c.where), F.lit(False)) if c.where else F.lit(True)
                    self._apply(table, c, hit, files)

    def rollback(self) -> None:
        self.base.clear()
        self.staged.clear()
        self.changes.clear()
        self.inserted.clear()
