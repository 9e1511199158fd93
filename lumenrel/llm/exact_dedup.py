"""Exact deduplication with a minimal perfect hash over the distinct digests of earlier documents.

Method: the digests of history go into hash-range buckets; each bucket gets a minimal perfect hash (pilots by
"hash and displace"), whose slots hold the full digest, the winner's doc_id and the group's size. Digests of the
new batch (pre-aggregated, so a group of copies is one row whatever its size) look up their slot; equal bytes mean a
repeat, anything else is a nonmember and groups on its own. Nothing is collected; a bucket holds about
``bucket_rows`` distinct digests at any corpus size.

Defined results: null text counts as empty; empty texts are equal to each other; repeated (doc_id, text) rows count as
rows of their group; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blank, join_groups, materialise

#: Stands for the winner of a group without any doc_id.
NO_ID = -(1 << 63)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit pairs; slot() of a stranger is some slot, so callers compare digests."""

    def __init__(self, n: int, pilots: np.ndarray):
        self.n, self.pilots = n, pilots

    @staticmethod
    def _parts(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = digests.view("<u8").reshape(-1, 4)
        return words[:, 1], words[:, 2]

    @classmethod
    def build(cls, digests: np.ndarray, per_bucket: float = 4.0) -> "PerfectHash":
        n = len(digests)
        a, b = cls._parts(digests)
        m = max(1, int(n / per_bucket))
        bucket = (a % np.uint64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=m)
        starts = np.concatenate([[0], np.cumsum(counts)])
        taken = np.zeros(n, bool)
        pilots = np.zeros(m, np.uint32)
        size = np.uint64(n)
        for g in np.argsort(-counts, kind="stable"):
            if not counts[g]:
                break
            own = b[order[starts[g] : starts[g + 1]]]
            pilot = 0
            while True:  # tries a block of pilots at a time
                tries = np.arange(pilot, pilot + 64, dtype=np.uint64)
                slots = (_mix(own[None, :] + (tries[:, None] + np.uint64(1)) * _M) % size).astype(np.int64)
                fit = ~taken[slots].any(axis=1)
                if len(own) > 1:
                    s = np.sort(slots, axis=1)
                    fit &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if fit.any():
                    k = int(np.argmax(fit))
                    taken[slots[k]] = True
                    pilots[g] = pilot + k
                    break
                pilot += 64
        return cls(n, pilots)

    def slot(self, digests: np.ndarray) -> np.ndarray:
        a, b = self._parts(digests)
        pilot = self.pilots[(a % np.uint64(len(self.pilots))).astype(np.int64)].astype(np.uint64)
        return (_mix(b + (pilot + np.uint64(1)) * _M) % np.uint64(self.n)).astype(np.int64)


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """history: (digest binary, keep_id long, group_size long), digests distinct. One index row a bucket."""

    def build(table: pa.Table) -> pa.Table:
        digests = _digests(table["digest"])
        index = PerfectHash.build(digests)
        at = index.slot(digests)
        slots = np.empty_like(digests)
        slots[at] = digests
        keep, size = np.empty(len(at), "<i8"), np.empty(len(at), "<i8")
        keep[at], size[at] = table["keep_id"].to_numpy(), table["group_size"].to_numpy()
        return pa.table(
            {
                "bucket": pa.array([table["bucket"][0].as_py()], pa.int32()),
                "pilots": pa.array([index.pilots.astype("<u4").tobytes()], pa.binary()),
                "slots": pa.array([slots.tobytes()], pa.binary()),
                "keep_ids": pa.array([keep.tobytes()], pa.binary()),
                "sizes": pa.array([size.tobytes()], pa.binary()),
            }
        )

    return (
        history.withColumn("bucket", _bucket("digest", buckets))
        .groupBy("bucket")
        .applyInArrow(build, "bucket int, pilots binary, slots binary, keep_ids binary, sizes binary")
    )


def merge(index: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """Looks up the batch's distinct digests; gives the groups of history and batch together: (digest, keep_id, group_size)."""

    def look_up(old: pa.Table, new: pa.Table) -> pa.Table:
        digests = _digests(new["digest"])
        keep, size = new["keep_id"].to_numpy(), new["group_size"].to_numpy()
        if not old.num_rows:
            return pa.table({"digest": new["digest"].cast(pa.binary()), "keep_id": pa.array(keep), "group_size": pa.array(size)})
        slots = np.frombuffer(old["slots"][0].as_py(), np.uint8).reshape(-1, 32)
        old_keep = np.frombuffer(old["keep_ids"][0].as_py(), "<i8").copy()
        old_size = np.frombuffer(old["sizes"][0].as_py(), "<i8").copy()
        if len(digests):
            at = PerfectHash(len(slots), np.frombuffer(old["pilots"][0].as_py(), "<u4")).slot(digests)
            member = (slots[at] == digests).all(axis=1)  # byte check
            old_keep[at[member]] = np.maximum(old_keep[at[member]], keep[member])
            old_size[at[member]] += size[member]
            digests, keep, size = digests[~member], keep[~member], size[~member]
        every = [*map(bytes, slots), *map(bytes, digests)]
        return pa.table(
            {"digest": pa.array(every, pa.binary()), "keep_id": pa.array(np.concatenate([old_keep, keep])), "group_size": pa.array(np.concatenate([old_size, size]))}
        )

    return (
        index.groupBy("bucket")
        .cogroup(batch.withColumn("bucket", _bucket("digest", buckets)).groupBy("bucket"))
        .applyInArrow(look_up, "digest binary, keep_id long, group_size long")
    )


def _bucket(col: str, buckets: int):
    return F.pmod(F.conv(F.substring(F.hex(col), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def deduplicate(docs: DataFrame, history=None, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 50_000) -> DataFrame:
    """docs and which of them are history (a Column; default: the older half of the ids) -> one row per document.

    Returns doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256.
    """
    rows = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (history if history is not None else F.lit(None).cast("boolean")).alias("old"),
            F.unhex(F.sha2(blank(text_col), 256)).alias("digest"),
        ),
        "digests",
    )
    if history is None:
        ids = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).first()
        rows = rows.withColumn("old", F.col("doc_id") < F.lit(((ids["a"] or 0) + (ids["z"] or 0)) // 2))
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    grouped = rows.withColumn("old", F.coalesce("old", F.lit(False))).groupBy("digest", "old")
    grouped = grouped.agg(F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("keep_id"), F.count("*").alias("group_size"))
    grouped = materialise(grouped, "digest-groups")
    old = grouped.filter("old").drop("old")
    new = grouped.filter("not old").drop("old")
    groups = merge(build_index(old, buckets), new, buckets)
    groups = materialise(groups.filter("group_size > 1"), "copy-groups")
    out = join_groups(rows.select("doc_id", "digest"), groups, "digest", "group_size").replace(NO_ID, None, "keep_id")
    return out.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("keep_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
