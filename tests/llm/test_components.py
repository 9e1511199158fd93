import random

from pyspark.sql import functions as F

from lumenrel.llm import _common


def brute(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return sorted((x, root(x)) for e in {(a, b) for a, b in edges if a != b} for x in e)


def found(spark, edges):
    rows, _ = _common.components(spark.createDataFrame(edges, "a long, b long"))
    return sorted(tuple(r) for r in rows.collect())


def test_against_union_find(spark):
    rng = random.Random(4)
    chain = list(range(60))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:]), *((1000, 1001 + i) for i in range(50)), *((2000 + i, 2500) for i in range(50)), (3000, 3000), (7, 7)]
    edges += [(4000 + rng.randrange(80), 4000 + rng.randrange(80)) for _ in range(60)]
    edges += edges[:20]
    assert found(spark, edges) == sorted(set(brute(edges)))
    assert found(spark, []) == []
    assert found(spark, [(5, 5)]) == []


def test_plans_of_rounds_are_small(spark, monkeypatch):
    plans = []
    kept = _common.materialise
    monkeypatch.setattr(_common, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or kept(df, name))
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") * 7 % 200).alias("b"))
    _common.components(edges)
    assert plans and max(len(p.splitlines()) for p in plans) < 100  # four steps a plan had 887 lines
