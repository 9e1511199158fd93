"""Exact similarity self-join on word shingles by Jaccard distance, as connected components.

Metric method. Regions: every shingle is a pivot {s}; a document lies nearest to the pivots it holds, and ties are broken
by one global order (rare shingles before those frequent in a sample, then by hash), so its cell is that of its first
shingle. Documents within the threshold of each other must meet in m of the cells of their first n - ceil(t n) + m
shingles; a document is replicated to those boundary cells. m grows with the set (``meetings``), so long texts that share a shingle by chance, whose
number of pairs grows with the square of the input, are no candidates. Windows: inside a cell the triangle inequality against the empty set
(sizes) and against parity sketches, whose Hamming distance never exceeds the symmetric difference, rules pairs out without
losing any. Pivot: a cell's most central member; members inside the pivot's ball are linked to it by an exact
distance, which joins them without looking at the pairs among them. Members left in other components are compared pair by pair in
blocks, with the same windows; only pairs that pass go on to exact distances over whole sets. There is no further recursion.
A pair that passes is not told by every cell it shares (hundreds, for near copies of long texts), but at both ends of each run of shared cells.
(Voronoi cells around documents don't work on text: nearly every distance is 1, so cells tie and windows hold nearly every document; the
README has figures.)

Documents with equal sets collapse first, so copies never meet as pairs. Nothing about the documents comes to the driver but the
sample's frequent shingles, which only order cells: at most ``most_frequent`` of them, from about ``sample_docs`` documents.

Defined results: null or empty text, or white space alone, has an empty set and links with nothing; texts of fewer than k words
have one shingle, the whole sequence; equal doc_ids are separate rows (a link of either counts for its own text);
rows without doc_id belong to the component of an equal set that has one, else they link with nothing and their component_id is null; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Tables, components, discard, join_groups, materialise, quoted, shuffles_end_with_query, text_key, unused
from ._hashing import mix, piece_hashes

SKETCH_BITS, BLOCK = 2048, 1024
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


#: A random odd number for each byte.
_OF_BYTE = np.random.default_rng(2).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of text that are worked on together, and words whose hashes are not by powers (longer ones could be made to collide).
PIECE, LONG_WORD = 1 << 18, 512


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, ends) of the words of a text whose last byte is white space."""
    c = np.frombuffer(raw, np.uint8)
    space = _IS_SPACE[c]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    h = piece_hashes(_OF_BYTE[c], start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return h, end


def shingle_batches(texts: list[str | None], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shingles, bounds) of runs of texts: sorted distinct 64-bit hashes of the k-word shingles; text i has shingles[bounds[i]:bounds[i + 1]].

    A-Z lower-cased, words split at ASCII white space.
    """
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        held.append(t.encode("utf-8", "surrogatepass").lower() if t else b"")
        size += len(held[-1])
        if size > PIECE or i + 1 == len(texts):
            yield _shingle(held, k)
            held, size = [], 0


def _shingle(raws: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    h, end = _word_hashes(b"\n".join([*raws, b""])) if raws else (np.empty(0, np.uint64), np.empty(0, np.int64))
    upto = np.concatenate([[0], np.searchsorted(end, np.cumsum([len(r) + 1 for r in raws]))])  # words before each text
    words = np.diff(upto)
    s = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        s += h[j : j + len(s)] * _ODD[j]
    s = mix(s)
    own = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    bounds = np.concatenate([[0], np.cumsum(own)])
    out = np.empty(bounds[-1], np.uint64)
    for i, (a, n, w) in enumerate(zip(upto.tolist(), own.tolist(), words.tolist())):
        at = bounds[i]
        if w >= k:
            part = out[at : at + n]
            part[:] = s[a : a + n]
            part.sort()
        elif w:
            out[at] = mix((h[a : a + w] * _ODD[:w]).sum(keepdims=True) + np.full(1, w, np.uint64) * _ODD[7])[0]
    if len(out):
        first = np.ones(len(out), bool)
        first[1:] = out[1:] != out[:-1]
        first[bounds[:-1][own > 0]] = True
        bounds = np.concatenate([[0], np.cumsum(first)])[bounds]
        out = out[first]
    return out, bounds


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The set of each text."""
    return [s[a:z] for s, bounds in shingle_batches(texts, k) for a, z in zip(bounds, bounds[1:])]


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    return total[bounds[1:]] - total[bounds[:-1]]


def signatures(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits of each set [sets, 2]."""
    a = _sums(mix(s + np.uint64(0x1234567)), bounds)
    b = _sums(mix(s ^ np.uint64(0x5BD1E9955BD1E995)), bounds) + np.diff(bounds).astype(np.uint64)
    return np.stack([a, b], axis=1)


def sketches(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parities of the sets in SKETCH_BITS bins [sets, SKETCH_BITS // 8]."""
    n = len(bounds) - 1
    out = np.empty((n, SKETCH_BITS // 8), np.uint8)
    for i in range(0, n, 64):
        z = min(n, i + 64)
        own = np.repeat(np.arange(z - i) * SKETCH_BITS, np.diff(bounds[i : z + 1]))
        bins = (s[bounds[i] : bounds[z]] >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64) + own
        parity = np.bincount(bins, minlength=(z - i) * SKETCH_BITS).astype(np.uint8) & 1
        out[i:z] = np.packbits(parity.reshape(z - i, -1), axis=1)
    return out


def meetings(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Cells in which a set must meet each set at least as large that is within the threshold; the order's prefixes are made for it."""
    return 1 + np.maximum(-(-num * n // den) - 1, 0) // 64


def _meetings(n: str, num: int, den: int) -> Column:
    """meetings() of a column of set sizes, 1 or more."""
    return F.expr(f"1 + (({num} * {n} + {den - 1}) div {den} - 1) div 64")


class Order:
    """The global order: shingles that are frequent in the sample come last, by rank."""

    def __init__(self, frequent: np.ndarray, rank: np.ndarray):
        self.frequent, self.rank = frequent, rank
        self.maybe = np.zeros(1 << 22, bool)  # most shingles aren't frequent: told by a table that stays in the processor's cache
        self.maybe[frequent >> np.uint64(42)] = True

    def place(self, s: np.ndarray) -> np.ndarray:
        """Rank of each shingle, -1 for those that aren't frequent."""
        out = np.full(len(s), -1, np.int64)
        at = np.flatnonzero(self.maybe[s >> np.uint64(42)])
        if len(at):
            i = np.minimum(np.searchsorted(self.frequent, s[at]), len(self.frequent) - 1)
            out[at] = np.where(self.frequent[i] == s[at], self.rank[i], -1)
        return out

    def prefixes(self, s: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingles, bounds) of each set's first n - ceil(t n) + meetings in the order, and how many of a set aren't frequent."""
        n = np.diff(bounds)
        wanted = np.where(n > 0, n - -(-num * n // den) + meetings(n, num, den), 0)
        place = self.place(s)
        plain = place < 0
        before = np.concatenate([[0], np.cumsum(plain)])
        rare = before[bounds[1:]] - before[bounds[:-1]]
        own = np.repeat(np.arange(len(n)), n)
        chosen = plain & (before[:-1] - before[bounds[:-1]][own] < wanted[own])
        for i in np.flatnonzero(rare < wanted).tolist():
            hot = bounds[i] + np.flatnonzero(~plain[bounds[i] : bounds[i + 1]])
            chosen[hot[np.argsort(place[hot], kind="stable")[: wanted[i] - rare[i]]]] = True
        return s[chosen], np.concatenate([[0], np.cumsum(chosen)])[bounds], rare


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    width = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


def _frequent(docs: DataFrame, k: int, sample_docs: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in three or more of about sample_docs documents: sorted hashes, and their rank by frequency."""
    total = docs.count()
    sample = docs
    if total > sample_docs:
        part = 1 << 20
        sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(part)) < max(1, part * sample_docs // total))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, _ in shingle_batches(b.column(1).to_pylist(), k):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["s"])

    counted = sample.select("doc_id", "text").mapInArrow(emit, "s long").groupBy("s").count().filter("count >= 3")
    with shuffles_end_with_query(docs.sparkSession):
        top = counted.orderBy(F.desc("count"), "s").limit(most).toArrow()
    s, n = top["s"].to_numpy().view(np.uint64), top["count"].to_numpy()
    order = np.argsort(s)
    rank = np.empty(len(s), np.int64)
    rank[np.lexsort((s, n))] = np.arange(len(s))
    return s[order], rank[order]


def describe(docs: DataFrame, k: int, num: int, den: int, sample_docs: int, most_frequent: int) -> DataFrame:
    """docs: (doc_id, text, key). A row per document: doc_id, key, n, sig, rare, sketch, keys (its boundary cells)."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k, sample_docs, most_frequent))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*shared.value)
        for b in batches:
            at = 0
            for s, bounds in shingle_batches(b.column(1).to_pylist(), k):
                m = len(bounds) - 1
                sig, wide = signatures(s, bounds), sketches(s, bounds)
                keys, key_bounds, rare = order.prefixes(s, bounds, num, den)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, m), b.column(2).slice(at, m), pa.array(np.diff(bounds)), _binary(sig.astype("<u8")), pa.array(rare), _binary(wide),
                     pa.ListArray.from_arrays(pa.array(key_bounds.astype(np.int32)), pa.array(keys.view(np.int64)))],
                    names=["doc_id", "key", "n", "sig", "rare", "sketch", "keys"],
                )
                at += m

    return docs.select("doc_id", "text", "key").mapInArrow(work, "doc_id long, key binary, n long, sig binary, rare long, sketch binary, keys array<long>")


def _allowed(sa: np.ndarray, sb: np.ndarray, total: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether pairs of sketches, of sets of so many shingles together, allow the threshold."""
    return (num + den) * np.bitwise_count(sa ^ sb).sum(axis=1, dtype=np.int64) <= (den - num) * total


def _near(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sketches allow the threshold."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(t.column(i).to_pylist()), np.uint64).reshape(t.num_rows, -1) for i in (4, 5))
            yield t.select(["a", "b"]).filter(pa.array(_allowed(sa, sb, t.column(2).to_numpy() + t.column(3).to_numpy(), num, den)))

    return both.mapInArrow(keep, "a long, b long")


def _links(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) at the threshold or over, by exact distances of whole sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = docs.select("doc_id", "text").join(reps.select("node", "sig", F.col("rep").alias("doc_id")).join(wanted, "node"), "doc_id")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for s, bounds in shingle_batches(b.column(2).to_pylist(), k):
                nodes = b.column(0).slice(at, len(bounds) - 1)
                sigs = np.frombuffer(b"".join(b.column(1).slice(at, len(nodes)).to_pylist()), "<u8").reshape(-1, 2)
                at += len(nodes)
                own = (signatures(s, bounds) == sigs).all(axis=1)  # another row may have this doc_id
                sets = [s[bounds[i] : bounds[i + 1]].tobytes() for i in np.flatnonzero(own)]
                yield pa.RecordBatch.from_arrays([nodes.filter(pa.array(own)), pa.array(sets, pa.binary())], names=["node", "s"])

    loaded = materialise(texts.select("node", "sig", "text").mapInArrow(load, "node long, s binary"), "sets")
    sets = loaded.dropDuplicates(["node"])
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for sa, sb in zip(t.column(2), t.column(3)):
                x, y = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(den * same >= num * (len(x) + len(y) - same))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = materialise(both.select("a", "b", "sa", "sb").mapInArrow(measure, "a long, b long"), "links")
    discard(loaded)
    return out


def _runs(rows: DataFrame) -> DataFrame:
    """rows: (key, node, ...), each node's cells. With pos, a cell's place among its node's by key, and the keys before and after it (its own where there is none)."""
    by_key = Window.partitionBy("node").orderBy("key")
    return rows.withColumns({"pos": F.row_number().over(by_key).cast("long"), "before": F.lag("key", 1).over(by_key), "after": F.lead("key", 1).over(by_key)}).withColumns(
        {"before": F.coalesce("before", "key"), "after": F.coalesce("after", "key")}
    )


def _cells(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows: (key, members, node, n, comp, pos, before, after, sketch). Rows (a, b, need, shared) of pairs of different components that pass the windows; a pair's shared sum up to the number of cells it shares.

    Cells that follow each other for both nodes are a run; a run from place p to place q of the first node is told by -p in its first cell and q + 1 in its last.
    A cell of over BLOCK members is dealt into blocks, and each pair of blocks is a task's group of its own.
    """
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(5)), parts).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "comp", "pos", "before", "after", "sketch")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def one(t: list[np.ndarray], sketch: np.ndarray) -> Iterator[np.ndarray]:
        key, i, j, own, node, n, comp, pos, before, after = t
        for a in range(0, len(node), 128):
            z = slice(a, min(a + 128, len(node)))
            na, nb = n[z, None], n[None, :]
            fit = (node[z, None] < node[None, :]) & (comp[z, None] != comp[None, :]) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb))
            if i[0] != j[0]:
                fit &= own[z, None] != own[None, :]
            p, q = np.nonzero(fit)
            p += a
            first = (before[p] != before[q]) | (before[p] == key[0])
            last = (after[p] != after[q]) | (after[p] == key[0])
            told = np.flatnonzero(first | last)
            for at in range(0, len(told), 16384):
                some = told[at : at + 16384]
                x, y = p[some], q[some]
                ok = _allowed(sketch[x], sketch[y], n[x] + n[y], num, den)
                if ok.any():
                    x, y, some = x[ok], y[ok], some[ok]
                    yield np.stack([node[x], node[y], meetings(np.minimum(n[x], n[y]), num, den), last[some] * (pos[x] + 1) - first[some] * pos[x]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = [table.column(c).to_numpy() for c in ("key", "i", "j", "own", "node", "n", "comp", "pos", "before", "after")]
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(table.num_rows, -1)
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            for a, z in zip([0, *cut], [*cut, table.num_rows]):
                if z - a > 1:
                    for pairs in one([c[a:z] for c in cols], sketch[a:z]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b", "need", "shared"])

        def cell(b: pa.RecordBatch, r: int) -> tuple:
            return tuple(b.column(c)[r].as_py() for c in ("key", "i", "j"))

        for b in batches:
            if not b.num_rows:
                continue
            if held and cell(held[-1], held[-1].num_rows - 1) != cell(b, 0):
                yield from flush(pa.Table.from_batches(held))
                held = []
            # the batch's last cell may go on in the next batch
            last, r = cell(b, b.num_rows - 1), b.num_rows - 1
            while r > 0 and cell(b, r - 1) == last:
                r -= 1
            if r > 0:
                yield from flush(pa.Table.from_batches([*held, b.slice(0, r)]))
                held = []
            held.append(b.slice(r))
        if held:
            yield from flush(pa.Table.from_batches(held))

    return dealt.mapInArrow(work, "a long, b long, need long, shared long")


def _linked(docs: DataFrame, k: int, similarity: tuple[int, int], sample_docs: int, most_frequent: int, tables: Tables) -> DataFrame:
    """docs: (doc_id, text, key). A row each: doc_id, key, n, component (null for empty sets), component_id. tables: gets the tables it is read from."""
    num, den = similarity
    every = tables.make(describe(docs, k, num, den, sample_docs, most_frequent), "shingled")
    rows = tables.make(every.select("doc_id", "key", "n", "sig"), "rows")
    full = every.filter("n > 0").drop("key")
    copies = tables.make(full.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"), "equal-sets")
    named = join_groups(full, copies, "sig", "copies")
    named = named.filter("copies is null or rep <=> doc_id").withColumn("rep", F.coalesce("rep", "doc_id"))
    # Equal (doc_id, text) rows would stand for a node twice.
    twice = named.filter("copies > 1").dropDuplicates(["sig"])
    nodes = named.filter("copies is null").unionByName(twice)
    # A node's number is made as the table is written, so it is fixed and its own.
    nodes = tables.make(nodes.select(F.monotonically_increasing_id().alias("node"), "sig", "rep", "n", "rare", "sketch", "keys"), "nodes")
    tables.drop(every)

    cells = nodes.select(F.explode("keys").alias("key"), "node", "n", F.least("rare", F.lit((1 << 22) - 1)).alias("rare"))
    code = F.shiftleft(F.col("rare"), 40).bitwiseOR(F.shiftrightunsigned(F.xxhash64("node"), 24))
    cells = cells.select("key", "node", "n", code.alias("code"))
    shared = tables.make(cells.groupBy("key").agg(F.min("code").alias("first"), F.count("*").alias("members")).filter("members > 1"), "cell-keys")
    meets = tables.make(join_groups(cells, shared, "key", "members", "inner").select("key", "node", "n", "members", (F.col("code") == F.col("first")).alias("central")), "cells")
    tables.drop(shared)
    pivots = tables.make(meets.filter("central").groupBy("key").agg(F.first("members").alias("size"), F.min("node").alias("pivot"), F.min_by("n", "node").alias("pn")), "pivots")
    fits = den * F.least("n", "pn") >= num * F.greatest("n", "pn")
    star = join_groups(meets, pivots, "key", "size", "inner").filter("node <> pivot").filter(fits)
    star = star.groupBy(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).agg(
        _meetings("min(least(n, pn))", num, den).alias("need"), F.count("*").alias("shared"), F.count_if(F.col("size") == 2).alias("twos")
    )
    star = tables.make(star.filter("shared >= need or twos > 0"), "star-met")
    reps = tables.make(nodes.select("node", "sig", "rep"), "reps")
    links = _links(tables.make(_near(star.filter("shared >= need").select("a", "b"), nodes, num, den), "star"), docs, reps, k, num, den)
    tables.made.append(links)
    comps, stored = components(links)
    tables.made.append(stored)

    left = meets.filter("members > 2").join(comps, "node", "left").select("key", "members", "node", "n", F.coalesce("component", "node").alias("comp"))
    left = tables.make(left, "cells-left")
    tables.drop(meets, pivots)
    open_cells = left.groupBy("key").agg(F.first("members").alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key", "size")
    left = join_groups(left, tables.make(open_cells, "open-cells"), "key", "size", "inner").drop("size")
    left = _runs(left).join(nodes.select("node", "sketch"), "node")
    # Cells of two are not looked at again; what their pairs lack of the meetings may be in larger cells.
    twos = star.filter("shared < need").select("a", "b", "need", F.col("twos").alias("shared"))
    met = _cells(left, num, den).unionByName(twos).groupBy("a", "b", "need").agg(F.sum("shared").alias("shared")).filter("shared >= need")
    rest = tables.make(met.select("a", "b"), "cross")
    tables.drop(nodes, star)
    if not rest.isEmpty():
        more = _links(rest, docs, reps, k, num, den)
        tables.made.append(more)
        comps, stored = components(stored.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(more))
        tables.made.append(stored)

    # A component's name is its smallest node; its smallest doc_id comes with the texts that the nodes stand for.
    own = comps.join(reps, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = comps.join(own, "component").select("node", "component", "component_id")
    by_set = reps.join(of_node, "node", "left").select("sig", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "rep").alias("component_id"))
    by_set = tables.make(by_set.join(copies.select("sig", "copies"), "sig", "left").withColumn("copies", F.coalesce("copies", F.lit(1))), "set-components")
    tables.drop_but(rows, by_set)
    out = join_groups(rows.filter("n > 0"), by_set, "sig", "copies").select("doc_id", "key", "n", "component", "component_id")
    none = rows.filter("n = 0").select("doc_id", "key", "n", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return out.unionByName(none)


def link_components(
    docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000, most_frequent: int = 500_000
) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    docs = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"), F.lit(None).cast("binary").alias("key"))
    return _linked(docs, k, similarity, sample_docs, most_frequent, Tables()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000, most_frequent: int = 500_000, most_broadcast: int = 500_000) -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id stays; columns as they were.

    Of several rows of a component with that doc_id the one with the smallest hash of the text stays, of equal rows any one.
    Different texts with one doc_id stay unless each is a copy. Texts without words, and rows without doc_id, all stay.
    """
    plain = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    plain = plain.withColumn("key", text_key("text"))
    tables = Tables()
    found = _linked(plain, k, similarity, sample_docs, most_frequent, tables).filter("n > 0 and doc_id is not null")
    each = tables.make(found.groupBy("doc_id", "key", "component", "component_id").agg(F.count("*").alias("rows")), "linked-rows")
    first = each.groupBy("component").agg(F.count("*").alias("size"), F.min(F.when(F.col("doc_id") == F.col("component_id"), F.col("key"))).alias("first"))
    each = join_groups(each, tables.make(first, "linked-first"), "component", "size", "inner")
    each = each.withColumn("stays", (F.col("doc_id") == F.col("component_id")) & (F.col("key") == F.col("first")))
    name_id, name_key, name_stays, name_key2 = unused(docs, "id", "key", "stays", "key2")
    marked = each.filter("not stays or rows > 1").select(F.col("doc_id").alias(name_id), F.col("key").alias(name_key), F.col("stays").alias(name_stays))
    marked = materialise(marked, "marked")
    tables.drop_but()
    # rows of about 60 bytes; beyond the bound both sides are shuffled
    marked = F.broadcast(marked) if marked.count() <= most_broadcast else marked
    keyed = docs.withColumn(name_key2, text_key(quoted(text_col).cast("string")))
    joined = keyed.join(marked, (quoted(id_col).cast("long") == F.col(name_id)) & (F.col(name_key2) == F.col(name_key)), "left")
    columns = [quoted(c) for c in docs.columns]
    alone = joined.filter(F.col(name_stays).isNull()).select(*columns)
    return alone.unionByName(joined.filter(F.col(name_stays)).dropDuplicates([name_id, name_key]).select(*columns))
