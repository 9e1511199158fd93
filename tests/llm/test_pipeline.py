import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lumenrel.llm import decontaminate, mixing, quality
from lumenrel.llm.queries import tokenizer_path
from tests.llm.test_jaccard_join import brute as near_brute

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    left = [d for d in sorted(rows) if scores[d] == 1]
    left = [d for d, _, c in near_brute([(d, rows[d]["text"]) for d in left], 5, 80, 100) if d == c]
    items = [" ".join(re.findall(r"\S+", r["text"].lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [d for d in left if not any(i in " ".join(rows[d]["text"].lower().split()) for i in items)]
    kept = docs.filter(docs.doc_id.isin(left))
    copies = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(kept).collect()})
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == +copies and sum(copies.values()) > 50
    lib, at = Tokenizer.from_file(tokenizer_path()), 0
    for r in sorted(got, key=lambda r: r["start"]):
        ids = np.array(lib.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids + [1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_stages_keep_columns_and_take_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", None, 0), (None, "a b", "en", "s", 3), (2, "", "en", None, 0), (3, "x " * 9000, None, "s", 1)], schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
