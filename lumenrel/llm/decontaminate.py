"""Benchmark decontamination by templates, with DataFrame functions only.

Method: numbers, units and names in documents and benchmark items become typed placeholders, word by word, so words keep their
places; windows of five template words are hashed and joined by hash; the matches of a document and an item are then checked for
consistent slots: along one alignment (document place minus item place) each value that the item has in a slot must stand for
one value in the document. So a question with other numbers or names is caught, and a chance meeting of templates isn't.

A capitalised word that begins a sentence, line or quotation may be a name or not, so each window has two forms: with such words as they
are, and with every capitalised word as a name. Each form is matched with its like and has alignments of its own; a window counts when either
form is found. White space is one space before names are looked for.

An item counts as found when consistent alignments cover at least ``coverage`` of its windows, or ``enough`` windows
(13 words in a row make 9). Windows with under two words besides placeholders say nothing and are left out.

With ``exact`` (op7_decontamination, pipeline) items without such a window, and items in scripts without spaces, are found verbatim: all their units in
a row, where a unit is a lower-cased word, or one character of a script without spaces. Their first 8, 4, 2 or 1 units are joined
by hash, then all units are compared; such an item counts as one window. Without ``exact`` these items match nothing.

The benchmark's windows are broadcast when they number ``most_broadcast`` at most (about 25 MB), else shuffled.

Defined results: null or empty text has no windows; items or texts of fewer than five words match nothing but by ``exact``; repeated rows get the same
result each; benchmark items with equal text all count; extra columns are ignored by ``find`` and kept by ``remove``; an empty table gives an
empty result, an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, quoted, text_key, unused
from ._common import blank as _blank

SPACE = r"[\x20\x09-\x0D]+"
#: Unit words and signs.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|in|mph|km/h|l|ml|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|percent|%|dollars?|cents?|euros?|pounds?|usd|eur|meters?|metres?|miles?|feet|inches|liters?|litres?|grams?|kilograms?"
NUM, UNIT, NAME = "‹num›", "‹unit›", "‹name›"


def blank(name: str) -> Column:
    return _blank(quoted(name).cast("string"))


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of doc_id and text."""
    return text_key(F.concat(F.coalesce(quoted(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"), blank(text_col)))


#: White space that isn't one space.
_ODD_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def _spaced(text: Column) -> Column:
    """With one space for each run of white space, and names but for those that begin a sentence as placeholders."""
    return F.regexp_replace(F.regexp_replace(text, _ODD_SPACE, " "), r"(?<=[\p{Ll}\p{Nd},;:] )\p{Lu}\p{Ll}+", NAME)


def _numbered(spaced: Column) -> Column:
    return F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, r"[0-9]+(?:[.,][0-9]{1,9}){0,4}", NUM)).otherwise(spaced)


def _unit_words(numbered: Column) -> Column:
    return F.when(numbered.contains(NUM), F.regexp_replace(numbered, rf"(?i)(?<={NUM}|{NUM} )(?:{UNITS})(?![\p{{L}}\p{{Nd}}])", UNIT)).otherwise(numbered)


def _unit_signs(out: Column) -> Column:
    some = out.contains("$" + NUM) | out.contains("€" + NUM) | out.contains("£" + NUM)
    return F.when(some, F.regexp_replace(out, rf"[$€£](?={NUM})", UNIT)).otherwise(out)


def _every_name(placed: Column) -> Column:
    return F.regexp_replace(placed, r"(?<![\p{L}\p{Nd}‹])\p{Lu}\p{Ll}+", NAME)


def canonical(text: Column, every_name: bool = False) -> Column:
    """The text with placeholders, lower-cased; it has as many words as the text. every_name: capitalised words at the start of sentences too."""
    out = _unit_signs(_unit_words(_numbered(_spaced(text))))
    return F.lower(_every_name(out) if every_name else out)


def _windows(rows: DataFrame, names: list[str], width: int) -> DataFrame:
    """rows with the hashes of words in the columns ``names`` replaced by those of their windows.

    Windows are put together from windows of 1, 2, 4, ... words, each a column of its own, so that none is made twice.
    """

    def joined(left: str, right: str, shift: int) -> Column:
        n = F.greatest(F.size(right) - shift, F.lit(0))
        return F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), lambda a, b: F.xxhash64(a, b))

    rest, part = [c for c in rows.columns if c not in names], 1
    rows = rows.select(*rest, *(F.col(c).alias(f"{c}_1") for c in names))
    while 2 * part <= width:
        rows = rows.select("*", *(joined(f"{c}_{part}", f"{c}_{part}", part).alias(f"{c}_{2 * part}") for c in names))
        part *= 2
    done = part
    rows = rows.select("*", *(F.col(f"{c}_{part}").alias(f"{c}_w") for c in names))
    while done < width:
        while done + part > width:
            part //= 2
        kept = [c for c in rows.columns if not c.endswith("_w")]
        rows = rows.select(*kept, *(joined(f"{c}_w", f"{c}_{part}", done).alias(f"{c}_w") for c in names))
        done += part
    return rows.select(*rest, *(F.col(f"{c}_w").alias(c) for c in names))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


#: Scripts without spaces, and their punctuation.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\u3000-\u303F\uFF00-\uFFEF]"


def units(text: Column) -> Column:
    return words(F.regexp_replace(F.lower(text), f"({UNSPACED})", " $1 "))


def _hashes(tokens: Column, width: int) -> Column:
    places = F.sequence(F.lit(1), F.size(tokens) - width + 1)
    return F.when(F.size(tokens) >= width, F.transform(places, lambda i: F.xxhash64(F.slice(tokens, i, width))))


def _item_windows(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, place, form, hash, slots: array of (offset, value), windows of the item)."""
    items = benchmark.select(quoted(id_col).cast("long").alias("item_id"), blank(text_col).alias("text"))
    forms = F.explode(F.array(*(F.struct(F.lit(k).alias("form"), words(canonical(F.col("text"), k == 1)).alias("canon")) for k in (0, 1)))).alias("x")
    items = items.select("item_id", words(F.col("text")).alias("raw"), forms).select("item_id", "raw", "x.*")
    items = items.withColumn("hashes", _word_hashes(F.col("canon")))
    rows = _windows(items, ["hashes"], width)
    rows = rows.select("item_id", "form", "canon", "raw", F.posexplode_outer("hashes").alias("place", "hash")).filter("hash is not null")
    window = F.slice("canon", F.col("place") + 1, width)
    is_slot = lambda w: w.contains("‹")
    slots = F.filter(F.transform(window, lambda w, j: F.struct(j.alias("at"), F.when(is_slot(w), F.lower(F.element_at("raw", F.col("place") + j + 1))).alias("value"))), lambda s: s["value"].isNotNull())
    plain = F.size(F.filter(window, lambda w: ~is_slot(w)))
    rows = rows.select("item_id", "form", "place", "hash", slots.alias("slots"), plain.alias("plain")).filter("plain >= 2").drop("plain")
    sizes = rows.groupBy("item_id").agg(F.countDistinct("place").alias("windows"))
    return rows.join(sizes, "item_id")


def _exact(rows: DataFrame, benchmark: DataFrame, width: int, most_broadcast: int, id_col: str, text_col: str) -> DataFrame | None:
    """(row, item_id, matched, windows) of the items that windows can't find and the rows that hold them; None where there are no such items."""
    items = benchmark.select(quoted(id_col).cast("long").alias("item_id"), blank(text_col).alias("text")).withColumn("canon", words(canonical(F.col("text"))))
    plain = lambda i: F.size(F.filter(F.slice("canon", i, width), lambda w: ~w.contains("‹"))) >= 2
    has = F.when(F.size("canon") >= width, F.exists(F.sequence(F.lit(1), F.size("canon") - width + 1), plain)).otherwise(False)
    items = items.filter(~has | F.col("text").rlike(UNSPACED)).select("item_id", units(F.col("text")).alias("units")).filter(F.size("units") > 0)
    n = F.size("units")
    items = items.withColumn("lead", F.when(n >= 8, 8).when(n >= 4, 4).when(n >= 2, 2).otherwise(1))
    items = materialise(items.withColumn("hash", F.xxhash64(F.slice("units", F.lit(1), F.col("lead")))), "exact-items")
    leads = [r["lead"] for r in items.select("lead").distinct().collect()]
    if not leads:
        return None
    keys = items.select("lead", "hash").distinct()
    keys = F.broadcast(keys) if keys.count() <= most_broadcast else keys
    own = rows.select("row", units(F.col("text")).alias("own"))
    none = F.expr("CAST(array() AS array<struct<lead:int,at:int,hash:bigint>>)")

    def starting(k: int) -> Column:
        return F.coalesce(F.transform(_hashes(F.col("own"), k), lambda h, at: F.struct(F.lit(k).alias("lead"), (at + 1).alias("at"), h.alias("hash"))), none)

    hits = own.select("row", F.explode_outer(F.concat(*(starting(k) for k in leads))).alias("x")).select("row", "x.*").join(keys, ["lead", "hash"], "left_semi")
    hits = materialise(hits.distinct(), "exact-hits")
    held = own.join(hits.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    met = hits.join(items, ["lead", "hash"]).join(held, "row").filter(F.slice("own", F.col("at"), F.size("units")) == F.col("units"))
    return met.select("row", "item_id").distinct().select("row", "item_id", F.lit(1).cast("long").alias("matched"), F.lit(1).cast("long").alias("windows"))


def find(docs: DataFrame, benchmark: DataFrame, width: int = 5, coverage: float = 0.8, enough: int = 9, most_broadcast: int = 500_000, exact: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(row, item_id, matched, windows) of documents and the items found in them; row is row_key()."""
    items = materialise(_item_windows(benchmark, width, item_col, item_text_col), "item-windows")
    small = items.count() <= most_broadcast
    keys = items.select("hash").distinct()
    text = blank(text_col)
    # Generated code puts a deterministic column off to where it is used, here to each exploded window of its row; a random test, always true, prevents it.
    rows = docs.select(F.when(F.rand(0) < 2, row_key(id_col, text_col)).alias("row"), text.alias("text"))
    # Columns of their own, so that each is made once: inside a lambda they would be made again for each window.
    placed = rows.select("row", _spaced(F.col("text")).alias("p0"))
    for step in (_numbered, _unit_words, _unit_signs):
        placed = placed.select("row", step(F.col("p0")).alias("p0"))
    placed = placed.select("row", "p0", _every_name(F.col("p0")).alias("p1"))
    plain = lambda p: F.array_remove(F.split(F.lower(F.col(p)), " ", -1), "")
    hashes = placed.select("row", _word_hashes(plain("p0")).alias("a"), _word_hashes(plain("p1")).alias("b"))
    windows = _windows(hashes, ["a", "b"], width).select("row", F.arrays_zip("a", "b").alias("all"))
    # posexplode() would make the optimizer test the array before it is made, and so make it, and all that it is made of, again and again
    windows = windows.select("row", F.posexplode_outer("all").alias("at", "x")).select("row", "at", "x.a", "x.b")
    # form 2: both forms are the same window
    kind = F.when(F.col("a") == F.col("b"), 2).otherwise(0)
    if small:
        known = windows.join(F.broadcast(keys.withColumnRenamed("hash", "ka")), F.col("a") == F.col("ka"), "left").join(F.broadcast(keys.withColumnRenamed("hash", "kb")), F.col("b") == F.col("kb"), "left")
        known = known.filter("ka is not null or kb is not null")
        one, two = F.col("ka").isNotNull(), F.col("kb").isNotNull() & (F.col("a") != F.col("b"))
    else:
        known, one, two = windows.filter("a is not null"), F.lit(True), F.col("a") != F.col("b")
    forms = F.array(F.when(one, F.struct(kind.alias("kind"), F.col("a").alias("hash"))), F.when(two, F.struct(F.lit(1).alias("kind"), F.col("b").alias("hash"))))
    hits = known.select("row", "at", F.explode_outer(forms).alias("x")).filter("x is not null").select("row", "x.kind", "at", "x.hash")
    if not small:
        hits = hits.join(keys, "hash", "left_semi")
    hits = materialise(hits.distinct(), "window-hits")
    met = hits.join(items, "hash").filter((F.col("kind") == 2) | (F.col("kind") == F.col("form"))).withColumn("shift", F.col("at") - F.col("place"))

    # slot values of the documents that have a match with slots
    slotted = met.filter(F.size("slots") > 0).select("row", "item_id", "form", "shift", "at", F.explode("slots").alias("slot"))
    with_slots = slotted.select("row").distinct()
    raw = rows.join(with_slots, "row", "left_semi").dropDuplicates(["row"]).select("row", words(F.col("text")).alias("raw"))
    values = slotted.join(raw, "row").select("row", "item_id", "form", "shift", F.col("slot.value").alias("value"), F.lower(F.element_at("raw", F.col("at") + F.col("slot.at") + 1)).alias("own"))
    bad = values.groupBy("row", "item_id", "form", "shift", "value").agg(F.min("own").alias("a"), F.max("own").alias("z")).filter("a <> z").select("row", "item_id", "form", "shift").distinct()
    fine = met.join(bad, ["row", "item_id", "form", "shift"], "left_anti")
    counted = fine.groupBy("row", "item_id").agg(F.countDistinct("place").alias("matched"), F.first("windows").alias("windows"))
    counted = counted.filter(F.col("matched") >= F.least(F.ceil(F.col("windows") * coverage), F.lit(enough)))
    verbatim = _exact(rows, benchmark, width, most_broadcast, item_col, item_text_col) if exact else None
    if verbatim is None:
        return counted
    return counted.unionByName(verbatim).groupBy("row", "item_id").agg(F.max("matched").alias("matched"), F.max("windows").alias("windows"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """A row per document: doc_id, contaminated, n_items, items (sorted array of item_id), matched (windows of the item most matched)."""
    found = find(docs, benchmark, id_col=id_col, text_col=text_col, **parameters)
    per = found.groupBy("row").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"), F.max("matched").alias("matched"))
    per = materialise(per, "contaminated")
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(per, "row", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), zero("n_items"), F.coalesce("items", F.expr("CAST(array() AS array<bigint>)")).alias("items"), zero("matched")
    )


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """docs without those that hold a benchmark item; columns as they were."""
    found = find(docs, benchmark, id_col=id_col, text_col=text_col, **parameters)
    name_row, name_key = unused(docs, "row", "key")
    found = materialise(found.select(F.col("row").alias(name_row)).distinct(), "contaminated")
    keyed = docs.withColumn(name_key, row_key(id_col, text_col))
    return keyed.join(found, F.col(name_key) == F.col(name_row), "left_anti").select(*(quoted(c) for c in docs.columns))
