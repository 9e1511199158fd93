import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lumenrel.llm import licenses


def cosine(text):
    """(licence, score) by direct sums."""
    rows, idf, other = licenses.vectors()
    c = Counter(re.findall(r"[a-z0-9]+(?:\.[0-9]+)?", text.lower()))
    w = {k: n * idf.get(k, other) for k, n in c.items()}
    norm = math.sqrt(sum(x * x for x in w.values()))
    best = {}
    for k in {r[0] for r in rows}:
        dot = sum(w.get(word, 0) * weight for t, _, word, weight in rows if t == k)
        name = licenses.TEMPLATES[k][0]
        best[name] = max(best.get(name, 0), dot / norm if norm else 0)
    return best


ROWS = [
    (1, "root/LICENSE", "Released under the MIT License."),
    (2, "root/a/x.txt", "Some words of its own. Licensed under the Apache License, Version 2.0. More words."),
    (3, "root/a/y.txt", "No notice here."),
    (4, "root/a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
    (5, "root/a/b/c/d.txt", "plain"),
    (6, "rootless/z.txt", "plain"),
    (7, None, None),
    (8, "alone.txt", ""),
    (9, "root/two", "First line.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."),
    (10, "root/talk", "We discussed whether a license of any kind would ever please the whole committee, and nobody agreed on copyright."),
    (11, "root/a/b/COPYING", "Licensed under CC BY 4.0."),
    (3, "root/a/y.txt", "No notice here."),
    (None, "root/long.txt", "word " * 60_000 + "\nReleased under the MIT License."),
]


def test_scan(spark):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "doc_id long, path string, text string, license string, dir int")
    got = licenses.scan(docs, F.col("path")).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert {k: by[k]["license"] for k in by} == {1: "MIT", 2: "Apache-2.0", 3: None, 4: "GPL-3.0", 5: None, 6: None, 7: None, 8: None, 9: by[9]["license"], 10: None, 11: "CC-BY-4.0", None: "MIT"}
    assert by[9]["licenses"] == ["CC-BY-NC-4.0", "MIT"]
    assert {k for k in by if by[k]["license_file"]} == {1, 4, 11}
    assert {k: (by[k]["inherited"], by[k]["inherited_from"]) for k in (2, 3, 5, 6, 7, 8)} == {2: ("MIT", "root"), 3: ("MIT", "root"), 5: ("CC-BY-4.0,GPL-3.0", "root/a/b"), 6: (None, None), 7: (None, None), 8: (None, None)}
    assert by[2]["effective"] == "Apache-2.0" and by[3]["effective"] == "MIT" and by[6]["effective"] is None
    assert abs(by[4]["score"] - 1) < 2e-9


def test_scores_against_direct_sums(spark):
    texts = [t for _, _, t in ROWS if t and len(t) < 300] + [t for _, t in licenses.TEMPLATES] + ["MIT", "license license", "the GNU Lesser thing, version 3 license"]
    frame = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {(r["key"], r["license"]): r["score"] for r in licenses.match(spark, frame, 0.5).collect()}
    want = {(i, name): s for i, t in enumerate(texts) for name, s in cosine(t).items() if s >= 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in got)


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_full_texts_and_broken_headers(spark):
    full = dict(licenses.full_texts())
    assert len(full["Apache-2.0"]) > 4000 and len(full["GPL-3.0"]) > 4000
    named = [(name, f"{name}/LICENSE", text.replace("Copyright (c)", "Copyright (c) 2024 Ann Example")) for name, text in full.items()]
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"
    lesser = gpl.replace("General", "Lesser General").replace("program", "library")
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n"
    code = "int main() { return 0; }\n" * 300
    mark = lambda text, m: "".join(f"{m}{x}\n" for x in text.splitlines())
    headers = [
        ("GPL-3.0", "x/a.py", mark(gpl, "# ") + "\n" + code), ("GPL-3.0", "x/a.c", "/*\n" + mark(gpl, " * ") + " */\n\n" + code), ("LGPL-3.0", "x/b.c", mark(lesser, "// ") + "\n" + code),
        ("Apache-2.0", "x/c.c", "// Copyright 2024 Ann Example\n//\n" + mark(apache, "// ") + "\n" + code), ("MIT", "x/d.js", "/*\n" + mark(full["MIT"], " * ") + " */\n" + code),
    ]
    rows = [(i, path, text) for i, (_, path, text) in enumerate(named + headers)] + [(100 + i, f"{name}/src/x.txt", "plain") for i, name in enumerate(full)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    want = [w for w, _, _ in named + headers]
    assert [got[i]["license"] for i in range(len(want))] == want
    assert [got[i]["license_file"] for i in range(len(want))] == [True] * len(named) + [False] * len(headers)
    assert [got[100 + i]["inherited"] for i in range(len(full))] == list(full)
    assert all(got[i]["licenses"] == [w] for i, w in enumerate(want[: len(named)]))


TRIGGER = re.compile(licenses.TRIGGER)
MARKS = re.compile(r"(?im)^[ \t]*(?://+[!/]?|#+|/?\*+/?|--+|;+|%+|<!--+|rem\b|dnl\b|\"{3}|'{3})?[ \t]*(?=\S|$)|[ \t]*(?:\*+/|--+>)?[ \t]*$")


def cosines(text, templates):
    """Best score by licence over the templates."""
    rows, idf, other = licenses.vectors(templates)
    c = Counter(re.findall(r"[a-z0-9]+(?:\.[0-9]+)?", text.lower()))
    w = {k: n * idf.get(k, other) for k, n in c.items()}
    norm = math.sqrt(sum(x * x for x in w.values())) or 1
    dots, best = Counter(), {}
    for k, name, word, weight in rows:
        dots[k, name] += w.get(word, 0) * weight
    for (_, name), dot in dots.items():
        best[name] = max(best.get(name, 0), round(dot / norm, 9))
    return best


def first(found, least):
    """(licence, score) of the best at the threshold, ties to the first name."""
    ok = [(-s, name) for name, s in found.items() if s >= least]
    return (min(ok)[1], -min(ok)[0]) if ok else None


def brute_scan(rows):
    own, files, folders = [], [], {}
    for _, path, text in rows:
        text = text or ""
        plain = MARKS.sub("", text)
        blocks = [re.sub(r"\s+", " ", b).strip() for b in re.split(r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)\s*", plain)]
        sentences = lambda x: re.split(r"(?<=[.!?])\s+(?=[A-Z])", x)
        lines = [s for x in re.split(r"[\r\n]+", text) for s in sentences(x)] + [s for b in blocks if TRIGGER.search(b) for s in [*sentences(b), b]]
        best = {}
        for s in {x for x in lines if TRIGGER.search(x)}:
            known = [x for x in (first(cosines(s, licenses.TEMPLATES), 0.7), first(cosines(s, licenses.HEADERS), 0.7)) if x]
            if known:
                name, score = min(known, key=lambda x: (-x[1], x[0]))
                best[name] = max(best.get(name, 0), score)
        notice = first(cosines(text, licenses.TEMPLATES), 0.85) if TRIGGER.search(text) else None
        full = first(cosines(text, licenses.full_texts()), 0.85) if TRIGGER.search(text) else None
        top = min(((-s, n) for n, s in best.items()), default=None)
        own.append((full or (top and (top[1], -top[0])) or notice or (None,))[0])
        files.append((full or notice or (None,))[0])
        if files[-1] and path and "/" in path:
            folders.setdefault(path.rpartition("/")[0], set()).add(files[-1])
    out = []
    for (doc_id, path, _), name, file in zip(rows, own, files):
        folder = (path or "").rpartition("/")[0]
        while folder and folder not in folders:
            folder = folder.rpartition("/")[0]
        out.append((doc_id, name, file is not None, ",".join(sorted(folders[folder])) if folder else None, folder or None))
    return sorted(out, key=str)


def test_scan_against_brute_force(spark):
    rng = random.Random(6)
    full = dict(licenses.full_texts())
    pieces = [t for _, t in licenses.TEMPLATES] + [t for _, t in licenses.HEADERS] + ["Plain words only.", "A license is a license.", "Copyright 2020 by nobody.", "It rains in April. And more."]
    rows = []
    for i in range(140):
        folder = "/".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(0, 4)))
        text = rng.choice(["\n", " ", "\n\n", "\n# "]).join(rng.choice(pieces) for _ in range(rng.randrange(0, 4)))
        rows.append((i, f"{folder}/f{i}" if folder else rng.choice([None, f"f{i}"]), text))
    rows += [(200, "a/b/LICENSE", full["MIT"]), (201, "a/COPYING", full["ISC"].replace("Copyright", "Copyright (c) 1999 Bo")), (202, "c/c/c/d/e/LICENSE", full["BSD-3-Clause"]), (203, "c/c/c/d/e/f/g/x", "plain"), (204, "a/n", None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()
    assert sorted(((r["doc_id"], r["license"], r["license_file"], r["inherited"], r["inherited_from"]) for r in got), key=str) == brute_scan(rows)
    assert sum(r["inherited"] is not None for r in got) > 30
