import hashlib
import math
import random
import re

from lumenrel.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s)), lambda s: 10 <= len(digits(s)) <= 15]
    for k, (pattern, ok) in enumerate(zip((EMAIL, IP, CARD, PHONE), tests)):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if ok(m[0])]
    return sorted(out)


def expect(text):
    spans = brute(text)
    joined = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in spans)
    return (*(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest(), joined)


def texts():
    rng = random.Random(4)
    out = [
        None, "", "a@b.c", "a@b.c_d@e.f", "a.b@c d@e", "é😀 x.y+z@q-r.s.t. 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.04 ", "+1 (743) 555-3824 éeux +1+2 345 678 90123 +12 3456789012345678",
        "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111111111111 4111111111111111 5500005555555559", "@ + . 0", "x@y..z u@v.w. 1.2.3 1..2.3.4", "9" * 5000, "1 " * 20_000,
        "a" * 30_000 + "@", "b." * 9000 + "@c" + ".d" * 5000, " 41111111 1111 1111 a@bc.d ab@c.d", "4111 1111 1111 1111\n4111 1111\t1111 1111", "+3 99999 99999999999 99999.9.9.9.9",
    ]
    pool = ["a", "B", "1", "2", "55", "4111111111111111", "@", ".", "-", " ", "+", "(", ")", "_", "%", "é", "x@y.z", "1.2.3.4", "\n", "+1 (523) 555-1055"]
    return out + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]


def test_base_spans_against_patterns(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, spans string, row int")
    got = {r["doc_id"]: r for r in pii.detect(docs, support=10**9).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) == expect(t), (i, t and t[:200])


def test_disclosing_terms(spark):
    secret = "write to zanzibar agent a.b@c.de today"
    rows = [(i, f"note {'abcdefgh'[i]} {secret} common words here") for i in range(4)]
    rows += [(10 + i, "common words here and today and write") for i in range(90)] + [(160, "zanzibar " * 3), (None, None), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.detect(docs).collect()
    assert len(got) == len(rows)
    spans = next(r["spans"] for r in got if r["doc_id"] == 0)
    text = rows[0][1]
    terms = {text[int(a) : int(z)] for kind, a, z in (x.split(":") for x in spans.split(",")) if kind == "term"}
    assert terms == {"zanzibar", "agent"}
    assert {r["n_terms"] for r in got if r["doc_id"] is None or r["doc_id"] >= 10} == {0}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0] == "note a write to <TERM> <TERM> <EMAIL> today common words here" and clean[160] == rows[94][1]
    # copies of one text are no support
    copies = spark.createDataFrame([(i, secret) for i in range(9)], "doc_id long, text string")
    assert {r["n_terms"] for r in pii.detect(copies).collect()} == {0}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.detect(docs).collect() == [] and pii.sanitise(docs).collect() == []


def told_by_hand(rows, share=0.5, bits=3.0, support=3):
    """Spans of disclosing terms by direct counts over whole texts."""
    seen = []
    for _, text in rows:
        spans = [(a, z, f"{k}:{text[a:z].lower()}") for a, k, z in brute(text)]
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text or "") if len(m[0]) >= 4]
        seen.append(({e for _, _, e in spans}, [w for w in words if not any(a < w[1] and w[0] < z for a, z, _ in spans)]))
    has = [(es, {w for _, _, w in ws}) for es, ws in seen]
    told = set()
    for e in {e for es, _ in has for e in es}:
        rows_e = sum(e in es for es, _ in has)
        for t in {t for es, ts in has if e in es for t in ts}:
            rows_t = sum(t in ts for _, ts in has)
            both = [text for (_, text), (es, ts) in zip(rows, has) if e in es and t in ts]
            given = len(both) / rows_t
            if len(set(both)) >= support and given >= share and math.log2(given * len(rows) / rows_e) >= bits:
                told.add(t)
    return told, {i: sorted((a, z) for a, z, w in ws if w in told) for (i, _), (_, ws) in zip(rows, seen)}


def test_terms_of_whole_documents(spark):
    far = "Alias Zanzibar opens this note. Then a long way of other common words here goes on and on {}, until a line names a.b@c.de at last."
    rows = [(i, far.format("abcd"[i])) for i in range(4)] + [(10 + i, "this note opens: other common words, a long line until last, then names here goes alias") for i in range(90)]
    rows += [(160, "They met ZANZIBAR again, and zanzibarian cats."), (161, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.detect(docs, everywhere=True).collect()}
    assert got[160]["spans"] == "term:9:17" and got[0]["spans"].startswith("term:6:14,") and got[0]["n_terms"] == 1 and got[10]["n_terms"] == got[161]["n_terms"] == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, everywhere=True).collect()}
    assert clean[160] == "They met <TERM> again, and zanzibarian cats." and clean[161] is None


def test_terms_everywhere_against_direct_counts(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdéÉXyz") for _ in range(rng.randrange(3, 7))) for _ in range(150)]
    people = ["a.b@c.de", "x@y.zz", "+1 (743) 555-3824", "10.1.2.3", "who@else.org"]
    rows = []
    for i in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 9))]
        if i % 9 == 0:
            k = rng.randrange(5)
            words += [people[k], vocabulary[k].upper(), f"secret{vocabulary[-1 - k]}"]
            rng.shuffle(words)
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    rows += [(300, f"x{people[0]}é SECRET{vocabulary[-1]} {vocabulary[0]}"), (301, f"secret{vocabulary[-2]}"), (302, rows[9][1]), (303, "")]
    told, want = told_by_hand(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert told and want[301]
    for most in (500_000, 0):
        got = {r["doc_id"]: sorted((x["start"], x["end"]) for x in r["all"] if x["kind"] == 4) for r in pii.detect(docs, everywhere=True, most_broadcast=most).collect()}
        assert got == want
    assert pii.detect(docs.limit(0), everywhere=True).collect() == []


def test_sanitise_keeps_odd_names(spark):
    names = ["a.b", "__key", "__row", "__all", "base", "row"]
    docs = spark.createDataFrame([(1, "write a@b.cd", *["x"] * len(names)), (None, None, *["y"] * len(names))], f"doc_id long, text string, {', '.join(f'`{n}` string' for n in names)}")
    for everywhere in (False, True):
        out = pii.sanitise(docs, everywhere=everywhere)
        assert out.columns == docs.columns
        assert sorted((str(r["doc_id"]), r["text"], r["__key"], r["a.b"]) for r in out.collect()) == [("1", "write <EMAIL>", "x", "x"), ("None", None, "y", "y")]
