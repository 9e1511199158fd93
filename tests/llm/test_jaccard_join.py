import random
import re

import pytest

from lumenrel.llm import jaccard_join


def brute(rows, k, num, den):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) < k:
            sets.append({tuple(words)} if words else set())
        else:
            sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def make(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 120]))] for _ in range(12)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "two one", "one two three four", "é é é é é", "\x1c \x85 x y z"]
    for i in range(n):
        words = list(bases[0] if i % 3 == 0 else rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words = words + passage
        texts.append(rng.choice(" \n\t") .join(words).title() if rng.random() < 0.2 else " ".join(words))
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed,k,num,den,sample", [(1, 4, 85, 100, 20_000), (2, 5, 80, 100, 30), (3, 4, 85, 100, 1)])
def test_against_brute_force(spark, seed, k, num, den, sample, monkeypatch):
    rows = make(seed)
    rows += [rows[20], (rows[21][0], rows[40][1]), (None, rows[30][1]), (None, "quite alone here my friend")]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, n string, node int")
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    got = jaccard_join.link_components(docs, k=k, similarity=(num, den), sample_docs=sample)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k, num, den)


def test_keep_one(spark):
    rows = make(5, 60)
    docs = spark.createDataFrame([(d, t, "x") for d, t in [*rows, rows[15], (None, "a b")]], "doc_id long, text string, component_id string")
    kept = jaccard_join.keep_one(docs)
    want = sorted((d for d, n, c in brute(rows, 5, 80, 100) if d == c), key=str)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None), key=str) == want
    assert kept.filter("doc_id is null").count() == 1


def test_keep_one_with_repeated_ids_and_odd_names(spark):
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, words), (5, other), (7, words + " more"), (7, other.upper()), (5, "third text of its own here"), (9, "third text of its own here"), (5, other), (4, None), (4, "")]
    names = ["a.b", "__key", "__keep", "__n", "__id", "__stays", "component", "sig"]
    docs = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], ["doc_id", "text", *names])
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(5, words), (5, other), (5, "third text of its own here"), (4, None), (4, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_hot_cells_are_split(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.choice([1, 2, 6, 9])):
            words[rng.randrange(100)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.link_components(docs, k=4, similarity=(85, 100))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 4, 85, 100)


def test_long_text_and_empty_table(spark):
    long = " ".join(str(i) for i in range(30_000))
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, "x")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.link_components(docs).collect()) == [(1, 29_996, 1), (2, 29_997, 1), (3, 1, 3)]
    assert jaccard_join.link_components(docs.limit(0)).collect() == []
    assert jaccard_join.keep_one(docs.limit(0)).collect() == []


def test_shingle_sets_against_sets_of_words():
    rng = random.Random(3)
    vocabulary = ["a", "B", "b", "é", "É", "x" * 700, "x" * 701, "12", "İ"]
    texts = [None, "", " \n", *(rng.choice(" \t\n ").join(rng.choice(vocabulary) for _ in range(rng.randrange(12))) for _ in range(300)), " a b ", "x" * 700 + " " + "x" * 701]
    for k in (1, 4, 5):
        sets = jaccard_join.shingle_sets(texts * 2, k)
        assert len(sets) == 2 * len(texts) and all((a[1:] > a[:-1]).all() for a in sets)
        hashes = {}
        for text, found in zip(texts * 2, sets):
            words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            want = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
            assert len(found) == len(want)
            if len(want) == 1:
                assert hashes.setdefault(next(iter(want)), found[0]) == found[0]
        assert len(set(hashes.values())) == len(hashes)


def test_sketch_never_exceeds_the_difference():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, 20).astype(np.uint64)]))
        one, two = jaccard_join.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert int(np.bitwise_count(one ^ two).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_long_texts_that_share_little_are_no_candidates(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    passages = [[f"p{i}-{j}" for j in range(6)] for i in range(40)]
    rows = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(9000)]
        for p in rng.sample(passages, 8):
            at = rng.randrange(9000)
            words[at:at] = p
        rows.append((i, " ".join(words)))
    changed = rows[3][1].split()
    for at in rng.sample(range(9000), 200):
        changed[at] = "new"
    rows.append((100, " ".join(changed)))
    compared = []
    kept = jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda pairs, *rest: compared.append(pairs.count()) or kept(pairs, *rest))
    got = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, similarity=(85, 100), sample_docs=1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 4, 85, 100)
    assert sum(compared) <= 5  # whole sets are moved for each; pairs met by chance grow with the square of the rows


def test_pairs_are_not_told_by_every_cell_they_share(spark, monkeypatch):
    rng = random.Random(21)
    rows = []
    for group in range(3):
        base = [f"g{group}-{i}" for i in range(1500)]
        for i in range(14):
            words = list(base)
            for at in rng.sample(range(1500), rng.choice([6, 13, 16, 26, 30])):
                words[at] = f"x{rng.randrange(10**9)}"
            rows.append((100 * group + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    kept = type(docs).mapInArrow

    def counted(self, work, schema, *rest):
        out = kept(self, work, schema, *rest)
        if schema.startswith("a long, b long, need long"):
            made.append(out.count())
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    got = jaccard_join.link_components(docs, k=4, similarity=(85, 100))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 4, 85, 100)
    assert len(made) == 1 and 0 < made[0] <= 3000


def test_runs_sum_up_to_the_cells_that_pairs_share(spark, monkeypatch):
    rng = random.Random(22)
    cells = {rng.randrange(-(2**62), 2**62): rng.sample(range(30), rng.choice([2, 3, 8, 20])) for _ in range(200)}
    rows = [(key, len(nodes), node, 100, node % 7, bytes(jaccard_join.SKETCH_BITS // 8)) for key, nodes in cells.items() for node in nodes]
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    left = spark.createDataFrame(rows, "key long, members long, node long, n long, comp long, sketch binary")
    got = {}
    for a, b, need, shared in jaccard_join._cells(jaccard_join._runs(left), 85, 100).collect():
        got[a, b, need] = got.get((a, b, need), 0) + shared
    want = {}
    for nodes in cells.values():
        for a in nodes:
            for b in nodes:
                if a < b and a % 7 != b % 7:
                    want[a, b, 2] = want.get((a, b, 2), 0) + 1
    assert got == want


@pytest.mark.parametrize("num,den", [(1, 100), (50, 100), (80, 100), (85, 100), (100, 100)])
def test_sets_within_the_threshold_meet_often_enough(spark, num, den):
    import numpy as np

    rng = np.random.default_rng(num)
    frequent = np.sort(rng.integers(0, 2**64, 500, np.uint64))
    order = jaccard_join.Order(frequent, rng.permutation(500))
    for n in [1, 2, 3, 64, 65, 66, 130, 700, 5000]:
        x = np.unique(np.concatenate([rng.integers(0, 2**64, n, np.uint64), rng.choice(frequent, n // 10)]))
        y = x[rng.random(len(x)) < (1 + num / den) / 2]
        y = np.unique(np.concatenate([y, rng.integers(0, 2**64, len(x) // 20, np.uint64)]))
        same = len(np.intersect1d(x, y))
        if not same or den * same < num * (len(x) + len(y) - same):
            y = x[: max(1, -(-num * len(x) // den))]
        p, bounds, _ = order.prefixes(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), num, den)
        need = jaccard_join.meetings(np.array([min(len(x), len(y))]), num, den)[0]
        assert len(np.intersect1d(p[: bounds[1]], p[bounds[1] :])) >= need
        assert spark.range(1).selectExpr(f"{min(len(x), len(y))} as n").select(jaccard_join._meetings("n", num, den)).first()[0] == need
