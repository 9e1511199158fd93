"""Mixing sources to target weights.

Method. Every source's documents lie in hash order, cut into blocks of about ``block_words`` words (``most_blocks`` at most);
a block is a range of the hash, so its documents are a random draw. A source's target gives it a quota of whole
blocks: all of them once or twice, and the first k again; the block at the boundary is refined by further hash bits until
few documents are left, of which a first fit in hash order fills the rest of the target. A splitting tree then
deals the quotas to the output shards: each node draws its left half's share of every source from the multivariate
hypergeometric distribution, down to one shard, which makes each shard's block quota of every source exact; shards take
disjoint runs of each source's permuted blocks, and rows are shuffled within their shard by a hash. The shards of a document's copies, and its
place among them, are part of the plan: ``mix`` returns them and ``mixed_documents`` writes by them. There is a shard for each
``shard_words`` words of the targets, ``most_shards`` at most.

Targets: sources by code point (null last) weigh ``weights``, repeating; they share ``budget`` times all words; none takes over
``cap`` times its size, and what it can't take is shared again by weight.

The driver sees one row a source (over ``most_sources`` raise) and one a source for its boundary block, never documents. Defined results: null text has size 0;
equal (doc_id, source, text) rows are taken or left together; rows of size 0 take 0 words; a source without words has target
0; an empty table gives an empty result; extra columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, quoted, unused, word_count

HASH_BITS = 40


def targets(sizes: list[int], weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> list[float]:
    """Targets of sources in order: by weight, none above cap times its size, the excess reshared by weight."""
    out, left = [0.0] * len(sizes), budget * sum(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free:
        whole = sum(weights[i % len(weights)] for i in free)
        over = [i for i in free if left * weights[i % len(weights)] / whole > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i % len(weights)] / whole
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Deals quotas (blocks by source) to shards: an array [shards, sources] with exact column sums and even row sums."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    want = int(quotas.sum()) * left // shards
    part = np.zeros_like(quotas)
    if want:
        # numpy's marginals method holds up to 1e9 of a colour; larger quotas would be halved by the expectation first
        part = rng.multivariate_hypergeometric(quotas, want, method="marginals")
    return np.concatenate([splitting_tree(part, left, rng), splitting_tree(quotas - part, shards - left, rng)])


def mix(
    docs: DataFrame, weights=(5, 2, 1), budget=1.5, cap=2.0, block_words=1 << 16, most_blocks=4096, few=20_000, shards=None, seed=7, id_col="doc_id", source_col="source", text_col="text",
    shard_words=1 << 20, most_shards=1 << 14, most_sources=200_000,
) -> DataFrame:
    """A row per document: doc_id, text_hash (128 bits), source, size, source_size, target, copies, taken, block, shards (one a copy)."""
    spark = docs.sparkSession
    text = quoted(text_col).cast("string")
    rows = docs.select(
        quoted(id_col).cast("long").alias("doc_id"),
        quoted(source_col).cast("string").alias("source"),
        _text_hash(text).alias("text_hash"),
        word_count(text).alias("size"),
    )
    # identical rows are one unit
    units = rows.groupBy("doc_id", "source", "text_hash").agg(F.first("size").alias("size"), F.count("*").alias("rows"))
    units = units.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 64 - HASH_BITS))
    units = materialise(units, "mix-units")

    found = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words")).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"over {most_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["words"]) for r in found]
    aims = targets(sizes, weights, budget, cap)
    whole = [int(round(a)) // s if s else 0 for a, s in zip(aims, sizes)]
    rest = [int(round(a)) - w * s for a, w, s in zip(aims, whole, sizes)]
    if max(whole, default=0) > 3:
        raise ValueError("cap must be below 4")
    blocks = [max(1, min(most_blocks, -(-s // block_words))) for s in sizes]
    schema = "k int, source string, source_size long, target double, whole int, rest long, blocks int"
    table = spark.createDataFrame([(k, r["source"], sizes[k], float(aims[k]), whole[k], rest[k], blocks[k]) for k, r in enumerate(found)], schema)

    placed = units.join(table, units["source"].eqNullSafe(table["source"])).drop(table["source"])
    placed = placed.withColumn("block", F.shiftright(F.col("h") * F.col("blocks"), HASH_BITS).cast("int"))
    by_block = placed.groupBy("k", "rest", "block").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    # most_blocks rows a source at most
    upto = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    totals = by_block.withColumn("upto", F.sum("words").over(upto)).withColumn("inside", F.col("upto") <= F.col("rest"))
    edge = totals.filter("not inside").groupBy("k").agg(F.min("block").alias("edge"), F.min(F.col("upto") - F.col("words")).alias("before"))
    edges = {r["k"]: (r["edge"], r["rest"] - r["before"]) for r in edge.join(table.select("k", "rest"), "k").collect()}
    extra = [edges[k][0] if k in edges else blocks[k] for k in range(len(found))]  # blocks taken once more

    if shards is None:
        # the deal is held as shards x sources on the driver: 400 MB at most
        shards = max(1, min(most_shards, 50_000_000 // max(1, len(found)), int(sum(aims)) // shard_words))
    quotas = np.array([whole[k] * blocks[k] + extra[k] + (k in edges) for k in range(len(found))], np.int64)
    dealt = splitting_tree(quotas, shards, np.random.default_rng(seed)) if len(found) else np.zeros((shards, 0), np.int64)
    # a source's shards that have blocks: their number, and where their runs end
    runs = [(np.flatnonzero(dealt[:, k]), np.cumsum(dealt[:, k])) for k in range(len(found))]
    last = [(k, extra[k], own.tolist(), upto[own].tolist()) for k, (own, upto) in enumerate(runs)]
    last = spark.createDataFrame(last, "k int, extra int, own array<int>, bounds array<long>")

    chosen = _fill(placed, edges, seed, few)
    if chosen is not None:
        # null-safe: rows without doc_id take part like others
        chosen = materialise(chosen, "mix-edge").select(F.col("doc_id").alias("edge_id"), F.col("k").alias("edge_k"), F.col("text_hash").alias("edge_hash"), "again")
        same = placed["doc_id"].eqNullSafe(chosen["edge_id"]) & (placed["k"] == chosen["edge_k"]) & (placed["text_hash"] == chosen["edge_hash"])
        placed = placed.join(chosen, same, "left").drop("edge_id", "edge_k", "edge_hash")
    else:
        placed = placed.withColumn("again", F.lit(None).cast("boolean"))
    once_more = F.when(F.col("block") < F.col("extra"), 1).otherwise(F.coalesce(F.col("again").cast("int"), F.lit(0)))
    placed = placed.join(last, "k").withColumn("copies", F.col("whole") + once_more)
    out = placed.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", "copies", "rows", "block",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        # copy c of block b is the source's block c * blocks + b in the deal; the c-th time round the blocks that are taken once more come last
        F.expr("transform(filter(array(0, 1, 2, 3), c -> c < copies), c -> element_at(own, 1 + size(filter(bounds, b -> b <= c * blocks + block))))").alias("shards"),
    )
    return out.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("__i", "rows")


def _fill(placed: DataFrame, edges: dict, seed: int, few: int) -> DataFrame | None:
    """Which units of the boundary blocks are taken once more: (doc_id, k, text_hash, again)."""
    if not edges:
        return None
    spark = placed.sparkSession
    now = spark.createDataFrame([(k, int(b), int(left)) for k, (b, left) in edges.items()], "k int, block int, left long")
    rows = placed.select("doc_id", "k", "text_hash", "size", "rows", "h", "block").join(now, ["k", "block"])
    rows = rows.withColumn("fine", F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash"), 64 - HASH_BITS))
    taken = None
    for level in range(3):
        counts = rows.groupBy("k").count().agg(F.max("count")).first()[0] or 0
        if counts <= few:
            break
        bins = rows.withColumn("bin", F.shiftrightunsigned("fine", HASH_BITS - 12 * (level + 1)).bitwiseAND(4095))
        totals = bins.groupBy("k", "left", "bin").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
        upto = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        totals = totals.withColumn("upto", F.sum("words").over(upto))
        cut = totals.filter("upto > left").groupBy("k").agg(F.min("bin").alias("cut"), F.min(F.col("upto") - F.col("words")).alias("before"))
        bins = materialise(bins.join(cut, "k"), "mix-bins")
        inside = bins.filter("bin < cut").select("doc_id", "k", "text_hash")
        taken = inside if taken is None else taken.unionByName(inside)
        rows = bins.filter("bin = cut").withColumn("left", F.col("left") - F.col("before")).drop("bin", "cut", "before")

    def first_fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fine", "doc_id", "text_hash"])
        left, words = int(pdf["left"].iloc[0]), (pdf["size"] * pdf["rows"]).tolist()
        take = []
        for w in words:
            take.append(0 < w <= left)
            left -= w if take[-1] else 0
        best = min((w for w, t in zip(words, take) if w and not t), default=None)
        if best is not None and best - left < left:  # nearer the target with the smallest of the others
            take[next(i for i, w in enumerate(words) if w == best and not take[i])] = True
        return pdf.loc[take, ["doc_id", "k", "text_hash"]]

    end = rows.groupBy("k").applyInPandas(first_fit, "doc_id long, k int, text_hash binary")
    return (end if taken is None else taken.unionByName(end)).withColumn("again", F.lit(True))


def _text_hash(text: Column) -> Column:
    """128 bits; null has its own."""
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("\0")), "UTF-8")))


def mixed_documents(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", seed=7, **parameters) -> DataFrame:
    """The mix itself: rows of docs, repeated as often as they are taken, by shard and shuffled within it."""
    plan = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, seed=seed, **parameters)
    name_id, name_text, name_source, name_shards, name_hash, name_shard, name_order = unused(docs, "id", "text", "source", "shards", "hash", "shard", "order")
    plan = plan.filter("copies > 0").dropDuplicates(["doc_id", "text_hash", "source"])
    plan = materialise(plan.select(F.col("doc_id").alias(name_id), F.col("text_hash").alias(name_text), F.col("source").alias(name_source), F.col("shards").alias(name_shards)), "mix-plan")
    hashed = docs.withColumn(name_hash, _text_hash(quoted(text_col).cast("string")))
    same = quoted(id_col).cast("long").eqNullSafe(F.col(name_id)) & (F.col(name_hash) == F.col(name_text)) & quoted(source_col).cast("string").eqNullSafe(F.col(name_source))
    rows = hashed.join(plan, same).withColumn(name_shard, F.explode(name_shards))
    rows = rows.withColumn(name_order, F.xxhash64(F.lit(seed + 2), name_id, name_hash, name_shard))
    # 16 parts of a shard's shuffled order, by its first bits: no shard has to fit in one task
    rows = rows.repartition(quoted(name_shard), F.shiftrightunsigned(name_order, 60)).sortWithinPartitions(name_shard, name_order)
    return rows.select(*(quoted(c) for c in docs.columns))
