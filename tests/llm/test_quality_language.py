import itertools
import re
import unicodedata
import zlib

import numpy as np
import pytest

from lumenrel.llm import language, quality

SF = "/root/testdata/sf0.01"


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score(docs, labels)
    assert out.count() == docs.count()
    known = out.filter("held_out").join(labels, "doc_id").toPandas()
    assert len(known) > 100 and (known.predicted == known.quality).mean() > 0.95
    assert known.score.between(0, 1).all()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == out.filter("predicted = 1").count()


def test_quality_ignores_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = (sorted(map(tuple, quality.score(docs, x).collect())) for x in (labels, turned))
    assert [r[0] for r in a] == [r[0] for r in b] and np.allclose([r[2] for r in a], [r[2] for r in b])


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b", None), (3, "long " * 100_000, "z")], "doc_id long, text string, f0 string")
    labels = spark.createDataFrame([(3, None, 1), (None, 1, 0)], "doc_id long, quality int, f1 int")
    out = quality.score(docs, labels).collect()
    assert len(out) == 5 and {(r["score"], r["predicted"]) for r in out} == {(0.5, 1)}
    one = spark.createDataFrame([(i, 0) for i in (1, 2, 3)], "doc_id long, quality int")
    assert {(r["score"], r["predicted"]) for r in quality.score(docs, one).collect()} == {(0.0, 0)}
    assert quality.score(docs.limit(0), labels).collect() == []
    assert quality.keep_good(docs, one).collect() == []


def test_discriminant_equals_direct_density():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(400, 3)), rng.normal(1, 2, size=(600, 3))]
    n, s, q = np.array([400, 600]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x])
    model = quality.Discriminant.fit(n, s, q, shrink=0, ridge=0)
    point = rng.normal(size=(5, 3))
    log = []
    pooled = (q.sum(0) - sum(n[k] * np.outer(s[k] / n[k], s[k] / n[k]) for k in (0, 1))) / n.sum()
    for k in (0, 1):
        mean = s[k] / n[k]
        w = n[k] / (n[k] + 30)
        cov = w * (q[k] / n[k] - np.outer(mean, mean)) + (1 - w) * pooled
        d = point - mean
        log.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]) + np.log(n[k] / n.sum()))
    assert np.allclose(model.score(point), 1 / (1 + np.exp(log[0] - log[1])))


def test_quality_query_against_brute_force(spark):
    """op6_quality's rows, worked out again from each text's statistics and sums over the labelled texts that aren't held out."""
    from lumenrel.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    out = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    x = [quality.statistics([docs[d] for d, y in labels if y == k and not out(d) and d in docs]) for k in (0, 1)]
    model = quality.Discriminant.fit(np.array([float(len(a)) for a in x]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]))
    got = queries.op6_quality(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        want = model.score(quality.statistics([docs[r["doc_id"]]]))[0]
        assert abs(r["score"] - want) < 1e-6 and r["held_out"] == out(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.5)


def best_path(s, penalty):
    return max(itertools.product(range(s.shape[1]), repeat=len(s)), key=lambda p: sum(s[i, c] for i, c in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    value = lambda s, p, c: sum(s[i, x] for i, x in enumerate(p)) - c * sum(a != b for a, b in zip(p, p[1:]))
    for _ in range(60):
        s, penalty = rng.normal(0, 2, size=(7, 3)), rng.choice([0.5, 2.0, 5.0])
        want = value(s, best_path(s, penalty), penalty)
        assert value(s, language.viterbi(s, penalty), penalty) == pytest.approx(want)
        assert value(s, language.label(s, penalty), penalty) == pytest.approx(want)


def test_many_paths_equal_single_ones():
    rng = np.random.default_rng(5)
    texts = [rng.normal(0, 3, size=(n, 3)) for n in [1, 1, 2, 5, 40, 40, 300, 7]]
    for cells in (1, 200, 1 << 18):
        for s, path in zip(texts, language.viterbi_many(texts, 6.0, cells)):
            assert (path == language.viterbi(s, 6.0)).all()


def test_a_middling_language_takes_no_text_of_two_others():
    s = np.array([[3, -8, 0]] * 6 + [[-8, 3, 0]] * 6, float)
    assert language.label(s, 20.0).tolist() == [0] * 6 + [1] * 6


def brute_words(text):
    out, now = [], ""
    for c in (text or "").lower():
        if unicodedata.category(c)[0] == "L":
            now += c
        elif now:
            out.append(now)
            now = ""
    return out + [now] * bool(now)


def test_words_are_runs_of_letters():
    texts = [None, "", "½ ² Ⅷ ①", "a1b_c d-é 日本 ½x", "İx ǅ", "\ud800 z"]
    joined, start, end, upto = language.find_words(texts)
    got = [[joined[a:z] for a, z in zip(start[i:j].tolist(), end[i:j].tolist())] for i, j in zip(upto, upto[1:])]
    assert got == [brute_words(t) for t in texts]


def test_language_query_against_brute_force(spark):
    """op5_language's rows, worked out again text by text: words by category, scores a word at a time, Viterbi without shortcuts."""
    from lumenrel.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    got = {r["doc_id"]: r for r in queries.op5_language(spark, "/root/testdata/sf0.001").collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[:80]:
        words = brute_words(r["text"])
        if not words:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        s = np.concatenate([model.word_scores([w]) for w in words])
        path = language.viterbi(s, 20.0)
        share = np.bincount(path, minlength=len(model.languages)) / len(words)
        assert got[r["doc_id"]]["lang_pred"] == model.languages[int(share.argmax())]
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= got[r["doc_id"]]["score"] <= share.max() + 1e-6


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.predict(docs, language.train(docs)).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(out) == docs.count()
    assert (out[out.held_out].lang_pred == out[out.held_out].lang).mean() > 0.98


def test_language_spans_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    sample = {r["lang"]: r["text"] for r in docs.filter("length(text) > 900").dropDuplicates(["lang"]).collect()}
    cut = {k: " ".join(re.findall(r"[^\W\d_]+", v)[:80]) for k, v in sample.items()}
    mixed = cut["en"] + " " + cut["de"]
    rows = [(1, None), (2, ""), (3, "12 !? ½ ² Ⅷ ①"), (4, mixed), (4, mixed), (5, "日本語"), (None, cut["fr"]), (6, cut["en"] * 500)]
    test = spark.createDataFrame([(d, t, "es", 0) for d, t in rows], "doc_id long, text string, lang string, score int")
    got = language.predict(test, model).collect()
    assert [(r["lang_pred"], r["score"]) for r in got[:3]] == [("und", 0.0)] * 3
    langs = [x.split(":")[1] for x in got[3]["spans"].split(",")]
    assert langs == ["en", "de"] and abs(int(got[3]["spans"].split("-")[1].split(":")[0]) - 80) <= 4
    assert got[3] == got[4] and got[5]["lang_pred"] in model.languages
    assert got[6]["lang_pred"] == "fr" and got[7]["lang_pred"] == "en"
    none = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(test, none).collect()} == {"und"}
    assert language.predict(test.limit(0), model).collect() == []


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("привет мир", "ru"), ("hello world", "en"), ("γεια σου", "el")] * 6)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = list(language.predict_texts(model, ["незнакомо", "unseen", "άγνωστο"], 5.0))
    assert [g[0] for g in got] == ["ru", "en", "el"]
