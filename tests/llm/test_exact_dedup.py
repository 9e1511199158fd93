import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from lumenrel.llm import exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in rows:
        g = groups[text or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((doc_id, keep, len(g), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs, **more):
    return sorted((tuple(r) for r in exact_dedup.deduplicate(docs, **more).collect()), key=str)


def test_perfect_hash_is_minimal_and_checked():
    for n in (1, 2, 3, 100, 5000):
        d = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(n)), np.uint8).reshape(-1, 32)
        h = exact_dedup.PerfectHash.build(d)
        assert sorted(h.slot(d).tolist()) == list(range(n))
        strange = np.frombuffer(hashlib.sha256(b"x").digest(), np.uint8).reshape(1, 32)
        assert 0 <= h.slot(strange)[0] < n and not (d == strange).all(axis=1).any()


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "A", "a ", "é", "long " * 50_000] + [f"t{i}" for i in range(60)]
    rows = [(i, rng.choice(texts) if i % 3 else "hot copy") for i in range(2000)] + [(None, "a"), (None, "no id"), (None, "no id"), (3, "t1"), (3, "t1"), (-4, "t2")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", F.lit("clash")).withColumn("old", F.lit(1))
    assert run(docs.drop("old")) == brute(rows)
    assert run(docs, history=F.crc32(F.col("doc_id").cast("string")) % 2 == 0, bucket_rows=300) == brute(rows)
    assert run(docs, history=F.lit(True)) == run(docs, history=F.lit(False)) == brute(rows)


def test_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, kept string, digest string")
    assert run(docs) == []
