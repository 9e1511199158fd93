"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give them away.

Base kinds are e-mail, IP address, card number (Luhn) and phone number, found in whole texts. The method adds ``term`` spans: words
whose co-occurrence with a protected entity in the corpus discloses it. For a term t and an entity e, rows(t), rows(e) and rows(t, e) are
counted over all documents; t is disclosing when P(e | t) = rows(t, e) / rows(t) reaches ``share``, the pointwise mutual
information log2(P(e | t) / P(e)) reaches ``bits``, and ``support`` different texts show the pair (so copies of one text don't count).
Such terms are generalised (replaced by a placeholder) by ``sanitise``, as base spans are.

With ``everywhere`` (op9_pii) rows(t, e) counts whole documents, and a disclosing term is marked wherever it occurs outside base spans, in
documents without the entity too. Entities and terms are left out of the pairs only by bounds that no pair can pass: an entity in fewer
than ``support`` texts or in too many rows for ``bits``, a term in more rows than P(e | t) allows for the most frequent entity. Without
``everywhere`` only words beside an entity are counted and marked: ``words`` on each side within ``reach`` characters.

All of it is DataFrame functions. The patterns are rewritten without changing what they match: separators inside numbers and dots inside
domains first become private characters, so that no repeated group recurses and no run is tried from each of its
characters; a run of any length takes linear time. The spans of one text are put together by a fold that copies what it has, so a text
with n spans takes n * n / 2 copies of a span's reference.

Defined results: null text counts as empty: no spans; spans of different kinds may overlap, of one kind never; offsets are code points;
repeated rows get the same result each; rows without doc_id are treated like any other; extra columns are ignored by
``detect`` and kept by ``sanitise``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, quoted, text_key, unused

KINDS = ["email", "ip", "card", "phone"]
_SEP, _DOT = "\ue000", "\ue001"
_LOCAL = f"A-Za-z0-9._%+{_DOT}-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]*+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"(?<![0-9{_SEP}])[0-9][0-9{_SEP}]{{13,}}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"


def located(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, value) of the pattern's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("m"))
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["s"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"))).alias("s"))

    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("s")), step, lambda acc: acc["s"])
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of 14 to 19 digits passes."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of (start, kind number, end, value), sorted."""
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)")

    def when(test: Column, spans: Column) -> Column:
        return F.when(test, spans).otherwise(none)

    clean = F.translate(text, _SEP + _DOT, "??")
    dotted = F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    joined = F.regexp_replace(clean, r"(?<=[0-9])[ -](?=[0-9])", _SEP)
    part_ok = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    email = when(F.contains(text, F.lit("@")), located(dotted, EMAIL))
    ip = F.filter(when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), located(text, IP)), lambda x: F.forall(F.split(x["value"], r"\."), part_ok))
    card = F.filter(when(text.rlike(r"[0-9](?:[ -]?[0-9]){13}"), located(joined, CARD)), lambda x: F.length(_digits(x["value"])).between(14, 19))
    card = F.filter(card, lambda x: _luhn(_digits(x["value"])))
    phone = F.filter(when(F.contains(text, F.lit("+")), located(text, PHONE)), lambda x: F.length(_digits(x["value"])).between(10, 15))

    def named(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.translate(x["value"], _SEP + _DOT, " .").alias("value")))

    kinds = [named(spans, k) for k, spans in enumerate((email, ip, card, phone))]
    return F.array_sort(F.concat(*kinds))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in [*KINDS, "term"]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _context(text: Column, spans: Column, reach: int, words: int) -> Column:
    """Array of (entity, term, start, end): words beside each span, not inside any."""

    def around(x: Column) -> Column:
        first = F.greatest(x["start"] - reach, F.lit(0))
        before = located(F.substring(text, first + 1, x["start"] - first), r"\p{L}+")
        whole = F.filter(before, lambda w: (w["start"] > 0) | (first == 0))
        before = F.transform(F.slice(whole, F.greatest(F.size(whole) - words + 1, F.lit(1)), F.lit(words)), lambda w: F.struct((w["start"] + first).alias("start"), (w["end"] + first).alias("end"), w["value"].alias("value")))
        after = located(F.substring(text, x["end"] + 1, F.lit(reach)), r"\p{L}+")
        whole = F.filter(after, lambda w: w["end"] < reach)
        after = F.transform(F.slice(whole, 1, words), lambda w: F.struct((w["start"] + x["end"]).alias("start"), (w["end"] + x["end"]).alias("end"), w["value"].alias("value")))
        return F.transform(F.concat(before, after), lambda w: F.struct(F.concat(x["kind"].cast("string"), F.lit(":"), F.lower(x["value"])).alias("entity"), F.lower(w["value"]).alias("term"), w["start"].alias("start"), w["end"].alias("end")))

    near = F.filter(F.flatten(F.transform(spans, around)), lambda w: F.length(w["term"]) >= 4)
    return F.filter(near, lambda w: ~F.exists(spans, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))


def _outside(text: Column, spans: Column) -> Column:
    """Distinct words of four letters or more, lower-cased, that touch no span."""

    def step(acc: Column, x: Column) -> Column:
        piece = F.when(x["start"] > acc["at"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"])).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.array_append(acc["out"], piece).alias("out"))

    text = F.translate(text, _SEP, "?")
    none = F.expr("CAST(array() AS array<string>)")
    cut = F.aggregate(spans, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: F.array_join(F.array_append(a["out"], F.substring(text, a["at"] + 1, F.length(text))), _SEP))
    plain = F.when(F.size(spans) > 0, F.regexp_replace(cut, rf"(?<!\p{{L}})\p{{L}}*+{_SEP}\p{{L}}*+", " ")).otherwise(text)
    return F.array_distinct(F.transform(F.filter(F.split(plain, r"[^\p{L}]+"), lambda w: F.length(w) >= 4), lambda w: F.lower(w)))


def _entities(spans: str) -> Column:
    return F.array_distinct(F.transform(spans, lambda x: F.concat(x["kind"].cast("string"), F.lit(":"), F.lower(x["value"]))))


def _text(text_col: str) -> Column:
    return F.coalesce(quoted(text_col).cast("string"), F.lit(""))


def _row_key(id_col: str, text_col: str) -> Column:
    """128 bits of doc_id and text."""
    return text_key(F.concat(F.coalesce(quoted(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"), _text(text_col)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), _row_key(id_col, text_col).alias("row"), _text(text_col).alias("text"))
    return rows.withColumn("text_hash", text_key("text")).withColumn("base", base_spans(F.col("text")))


def _everywhere(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _rows(docs, id_col, text_col).select("doc_id", "row", "text_hash", "base", _outside(F.col("text"), F.col("base")).alias("words"))


def disclosing_terms(found: DataFrame, share: float = 0.5, bits: float = 3.0, support: int = 3, most_broadcast: int = 500_000) -> DataFrame | None:
    """Terms that disclose an entity by co-occurrence in whole documents; None where there can be none. found: rows of _everywhere, materialised."""
    total = found.count()
    holders = found.filter(F.size("base") > 0)
    of_entity = holders.select("text_hash", F.explode(_entities("base")).alias("entity")).groupBy("entity", "text_hash").count()
    of_entity = of_entity.groupBy("entity").agg(F.sum("count").alias("rows_e"), F.count("*").alias("texts"))
    of_entity = materialise(of_entity.filter((F.col("texts") >= support) & (F.log2(F.lit(total) / F.col("rows_e")) >= bits)).select("entity", "rows_e"), "term-entities")
    n, most = of_entity.agg(F.count("*"), F.max("rows_e")).first()
    if not n:
        return None
    of_entity = F.broadcast(of_entity) if n <= most_broadcast else of_entity
    every = found.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("rows_t"))
    every = materialise(every.filter(F.col("rows_t") >= support), "term-rows")
    possible = F.lit(most) / F.col("rows_t") >= share
    of_term = every.filter(possible)
    if of_term.count() <= most_broadcast:
        of_term, hot = F.broadcast(of_term), None
    else:
        # under 1,000 times the mean number of words a document, whatever the input is
        hot = F.broadcast(every.filter(~possible & (F.col("rows_t") > total / 1000)).select("term"))
    # equal texts are expanded once
    texts = holders.groupBy("text_hash").agg(F.count("*").alias("copies"), F.first(_entities("base")).alias("entities"))
    texts = texts.select("text_hash", "copies", F.explode("entities").alias("entity")).join(of_entity, "entity")
    texts = materialise(texts.groupBy("text_hash", "copies").agg(F.collect_list(F.struct("entity", "rows_e")).alias("entities")), "term-texts")
    terms = holders.join(texts, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text_hash", F.explode("words").alias("term"))
    terms = terms if hot is None else terms.join(hot, "term", "left_anti")
    pairs = terms.join(of_term, "term").join(texts, "text_hash").select("term", "rows_t", "copies", F.explode("entities").alias("x")).select("term", "rows_t", "copies", "x.*")
    pairs = pairs.filter(F.col("rows_e") / F.col("rows_t") >= share)
    both = pairs.groupBy("entity", "term", "rows_e", "rows_t").agg(F.sum("copies").alias("both"), F.count("*").alias("texts"))
    given = F.col("both") / F.col("rows_t")
    told = both.filter((F.col("texts") >= support) & (given >= share) & (F.log2(given * total / F.col("rows_e")) >= bits))
    return materialise(told.select("term").distinct(), "told")


def _marked(docs: DataFrame, found: DataFrame, told: DataFrame, id_col: str, text_col: str, most_broadcast: int = 500_000) -> DataFrame:
    """(row, terms): spans of the told terms wherever they occur; spans may still touch base spans."""
    told = F.broadcast(told) if told.count() <= most_broadcast else told
    held = found.select("row", F.explode("words").alias("term")).join(told, "term", "left_semi").groupBy("row").agg(F.collect_set("term").alias("held"))
    held = materialise(held, "held-terms")
    rows = docs.select(_row_key(id_col, text_col).alias("row"), _text(text_col).alias("text")).join(held, "row")
    # of letters, only a dotted capital I has a lower case of two characters, the second one no letter
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.replace(F.array_join("held", "|"), F.lit("i\u0307"), F.lit("\u0130")), F.lit(r")(?!\p{L})"))
    rows = rows.withColumn("pattern", pattern)
    spans = F.filter(located(F.col("text"), F.col("pattern")), lambda x: F.array_contains("held", F.lower(x["value"])))
    spans = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["end"].alias("end"), F.lower(x["value"]).alias("value")))
    return rows.select("row", spans.alias("terms")).dropDuplicates(["row"])


def _found(docs: DataFrame, id_col: str, text_col: str, reach: int, words: int) -> DataFrame:
    beside = F.when(F.size("base") > 0, _context(F.col("text"), F.col("base"), reach, words))
    return _rows(docs, id_col, text_col).select("doc_id", "row", "text_hash", "base", beside.alias("beside"))


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text", share: float = 0.5, bits: float = 3.0, support: int = 3) -> DataFrame:
    """(entity, term) pairs whose co-occurrence discloses the entity. Counts are over all rows of docs."""
    total = found.count()
    pairs = found.filter("beside is not null").select("text_hash", F.explode(F.array_distinct(F.transform("beside", lambda x: F.struct(x["entity"], x["term"])))).alias("x"))
    pairs = pairs.select("text_hash", "x.entity", "x.term")
    both = pairs.groupBy("entity", "term", "text_hash").count().groupBy("entity", "term").agg(F.sum("count").alias("both"), F.count("*").alias("texts"))
    both = materialise(both.filter(F.col("texts") >= support), "term-pairs")
    values = found.select(F.explode(F.array_distinct(F.transform("base", lambda x: F.concat(x["kind"].cast("string"), F.lit(":"), F.lower(x["value"]))))).alias("entity"))
    of_entity = values.groupBy("entity").agg(F.count("*").alias("rows_e"))
    terms = docs.select(F.explode(F.array_distinct(F.split(F.lower(quoted(text_col)), r"[^\p{L}]+"))).alias("term"))
    terms = terms.filter(F.length("term") >= 4).join(both.select("term").distinct(), "term", "left_semi")
    of_term = terms.groupBy("term").agg(F.count("*").alias("rows_t"))
    known = both.join(of_entity, "entity").join(of_term, "term")
    given = F.col("both") / F.col("rows_t")
    return known.filter((given >= share) & (F.log2(given * total / F.col("rows_e")) >= bits)).select("entity", "term")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 80, words: int = 4, everywhere: bool = False, **thresholds) -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, row (hash of doc_id and text), all (array of spans)."""
    if everywhere:
        found = materialise(_everywhere(docs, id_col, text_col), "entities")
        told = disclosing_terms(found, **thresholds)
        if told is None:
            out = found.withColumn("terms", F.lit(None).cast(found.schema["base"].dataType))
        else:
            out = found.select("doc_id", "row", "base").join(materialise(_marked(docs, found, told, id_col, text_col), "terms"), "row", "left")
            free = F.filter("terms", lambda w: ~F.exists("base", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
            out = out.withColumn("terms", F.when(F.size(free) > 0, free))
    else:
        found = materialise(_found(docs, id_col, text_col, reach, words), "entities")
        told = disclosing(docs, found, text_col, **thresholds)
        seen = found.filter("beside is not null").dropDuplicates(["row"]).select("row", F.explode("beside").alias("x")).select("row", "x.*")
        terms = seen.join(told, ["entity", "term"]).groupBy("row").agg(
            F.collect_set(F.struct(F.col("start"), F.lit(len(KINDS)).alias("kind"), F.col("end"), F.col("term").alias("value"))).alias("terms")
        )
        out = found.join(materialise(terms, "terms"), "row", "left")
    every = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "terms")))
    kinds = F.transform("base", lambda x: x["kind"])

    def count(kind: int) -> Column:
        return F.size(F.filter(kinds, lambda c: c == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    return out.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"), "row", every.alias("all"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """docs with each span's text replaced by its kind in angle brackets; overlapping spans become one, of the first kind."""
    name_row, name_all, name_key = unused(docs, "row", "all", "key")
    found = detect(docs, id_col, text_col, **parameters).filter(F.size("all") > 0).dropDuplicates(["row"]).select(F.col("row").alias(name_row), F.col("all").alias(name_all))
    text = _text(text_col)
    keyed = docs.withColumn(name_key, _row_key(id_col, text_col))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in [*KINDS, "term"]))

    def step(acc: Column, x: Column) -> Column:
        new = x["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), names[x["kind"]])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    cut = F.aggregate(name_all, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    joined = keyed.join(found, F.col(name_key) == F.col(name_row), "left")
    new = F.when(F.col(name_all).isNull(), quoted(text_col)).otherwise(cut)
    return joined.select(*(new.alias(c) if c == text_col else quoted(c) for c in docs.columns))
