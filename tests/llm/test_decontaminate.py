import random
import re

from lumenrel.llm import decontaminate as dec

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, items, coverage=0.8, enough=9):
    """Template match by direct comparison of words, for texts whose only slots are numbers."""
    canon = lambda t: [re.sub(r"[0-9]+(?:[.,][0-9]+)*", "#", w.lower()) for w in WORDS.findall(t or "")]
    out = {}
    for d, text in docs:
        dc, dr, hit = canon(text), WORDS.findall((text or "").lower()), []
        for i, item in items:
            ic, ir = canon(item), WORDS.findall((item or "").lower())
            places = [p for p in range(len(ic) - 4) if sum("#" not in w for w in ic[p : p + 5]) >= 2]
            shifts = {}
            for p in places:
                for a in range(len(dc) - 4):
                    if dc[a : a + 5] == ic[p : p + 5]:
                        shifts.setdefault(a - p, []).append(p)
            found = set()
            for s, ps in shifts.items():
                values, fine = {}, True
                for p in ps:
                    for j in range(p, p + 5):
                        if "#" in ic[j]:
                            fine &= values.setdefault(ir[j], dr[j + s]) == dr[j + s]
                if fine:
                    found |= set(ps)
            if places and len(found) >= min(-(-len(places) * coverage // 1), enough):
                hit.append(i)
        out[d] = sorted(hit)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    say = lambda n: " ".join(rng.choice(vocabulary) if rng.random() < 0.9 else str(rng.randrange(3)) for _ in range(n))
    items = [(i, say(rng.choice([4, 5, 8, 14, 30]))) for i in range(15)] + [(90, None), (91, ""), (92, "a b c"), (93, "1 2 3 4 5 6")]
    docs = []
    for d in range(120):
        text = say(rng.choice([0, 3, 20, 60]))
        if d % 2:
            item = rng.choice(items)[1] or ""
            words = item.split()
            if d % 3 == 0:  # other numbers, each the same everywhere
                words = [str(int(w) + 7) if w.isdigit() else w for w in words]
            elif d % 5 == 0:  # numbers at random
                words = [str(rng.randrange(99)) if w.isdigit() else w for w in words]
            elif d % 7 == 0:
                words = words[: len(words) // 2]
            text = f"{text} {' '.join(words).upper() if d % 11 == 0 else ' '.join(words)}\n{say(9)}"
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, "1 2 3 4 5 6 7 8"), (503, "x " * 50_000)]
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, row string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    for broadcast in (500_000, 0):
        got = {r["doc_id"]: r["items"] for r in dec.report(frame, bench, most_broadcast=broadcast).collect()}
        assert got == want
    assert any(want.values())
    kept = dec.remove(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, h in want.items() if not h)


def test_reparameterised_question(spark):
    bench = spark.createDataFrame([(1, "A train leaves Boston at 5 pm going 60 km/h while Anna drives 60 km from Boston to see Paul.")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "Q: A train leaves Dover at 7 pm going 82 km/h while Mary drives 82 km from Dover to see John."), (2, "A train leaves Dover at 7 pm going 82 km/h while Mary drives 19 km from Dover to see John."), (None, "nothing of the kind is here at all"), (1, "twin row of another text")],
        "doc_id long, text string",
    )
    got = sorted((str(r["doc_id"]), r["contaminated"]) for r in dec.report(docs, bench).collect())
    assert got == [("1", False), ("1", True), ("2", False), ("None", False)]
    assert dec.remove(docs, bench).count() == 3


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in dec.report(docs, bench).collect()] == [False]
    assert dec.report(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert dec.remove(docs, bench).count() == 1


def test_canonical_keeps_word_places(spark):
    for text in ["Pay $5 or 5kg, 1,000.5 Miles by Ann Lee; x9y", "12.34.56.78.90.12 a", "é 3 h. At Rome", "5 %"]:
        row = spark.createDataFrame([(text,)], "text string").select(dec.words(dec.canonical(dec.F.col("text"))).alias("a"), dec.words(dec.F.col("text")).alias("b")).first()
        assert len(row["a"]) == len(row["b"]), row


def test_names_at_sentence_starts(spark):
    items = [
        (1, "Tom has 12 apples. Tom gives 5 apples to Sue. How many apples does Tom have left?"),
        (2, "Janet sells 16 eggs at 2 dollars each. Janet bakes 4 muffins. How much does Janet make a day?"),
        (3, "The red bird sings at dawn near Anna while rain falls. The old dog sleeps by the warm fire"),
    ]
    docs = [
        (1, "Ben has 30 apples. Ben gives 9 apples to Ann. How many apples does Ben have left?"),
        (2, "Q:\n\"Ben has  30 apples.\nBen gives 9 apples\tto Ann. How many apples does Ben have left?"),
        (3, "Maria sells 20 eggs at 3 dollars each. Maria bakes 6 muffins. How much does Maria make a day?"),
        (4, "Ben has 30 apples. Kim gives 9 apples to Ann. How many apples does Lee have left?"),
        (5, "The red bird sings at dawn near Mary while rain falls. An old dog sleeps by the warm fire"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for broadcast in (500_000, 0):
        got = {r["doc_id"]: r["items"] for r in dec.report(spark.createDataFrame(docs, "doc_id long, text string"), bench, most_broadcast=broadcast).collect()}
        assert got == {1: [1], 2: [1], 3: [2], 4: [], 5: [3]}


def test_items_without_windows(spark):
    items = [(1, "12 15 18 21 24 27 30 ?"), (2, "Who wrote Faust?"), (3, "1+1等于几？请写出答案。"), (4, "日本の首都はどこですか"), (5, ""), (6, None), (7, "what is the tallest mountain on this whole earth today")]
    docs = [
        (1, "next in 12 15\n18  21 24 27 30 ? say"), (2, "12 15 18 21 24 27 31 ?"), (3, "Q: who WROTE faust? Goethe"), (4, "who wrote it"), (5, "问：1+1等于几？请写出答案。答：二"), (6, "1+1等于几？请写"),
        (7, "質問日本の首都はどこですか東京です"), (8, ""), (9, None), (10, "so what is the tallest mountain on this whole earth today"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for broadcast in (500_000, 0):
        got = {r["doc_id"]: r["items"] for r in dec.report(frame, bench, exact=True, most_broadcast=broadcast).collect()}
        assert got == {1: [1], 2: [], 3: [2], 4: [], 5: [3], 6: [], 7: [4], 8: [], 9: [], 10: [7]}
    assert sorted(r["doc_id"] for r in dec.remove(frame, bench, exact=True).collect()) == [2, 4, 6, 8, 9]


def test_remove_keeps_odd_names_and_rows(spark):
    item = "Alice bought 12 red apples and 5 green pears at the market on Monday"
    names = ["a.b", "__key", "__row", "row", "item_id"]
    rows = [(1, "so: " + item + " she said"), (2, "nothing of that kind is said here at all"), (None, None), (2, "nothing of that kind is said here at all"), (1, "another text of number one")]
    docs = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], ["doc_id", "text", *names])
    kept = dec.remove(docs, spark.createDataFrame([(7, item)], "item_id long, text string"), exact=True)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, rows[1:]))


def test_windows_of_any_width(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(n, [(n * 31 + i) % 7 for i in range(n)]) for n in range(12)], "n int, g array<long>")
    for width in (1, 2, 3, 5, 6, 7):
        found = {}
        for r in dec._windows(rows.withColumn("k", F.col("g")), ["g"], width).collect():
            own = [tuple(r["k"][i : i + width]) for i in range(max(0, r["n"] - width + 1))]
            assert len(own) == len(r["g"])
            for window, h in zip(own, r["g"]):
                assert found.setdefault(window, h) == h
        assert len(set(found.values())) == len(found)
