"""Benchmark decontamination by template canonicalisation.

In documents and benchmark items alike, numbers (not those within words), names (capitalised words) and units after a
number become typed placeholders, case and punctuation go, and every five-token window of the result is hashed; a
second form keeps names as words without case, so that other case or a decapitalised word costs nothing.
Windows are joined on the hash, and one is there if it is there in either form. An item is found in a document when at least ``SIMILARITY`` of its distinct windows
are there and its slots are filled consistently: within one alignment, a value of the item always stands
for the same value of the document. Each alignment is judged by itself; one that covers ``SIMILARITY`` of the windows
with slots, or the one that covers most, has to be consistent; capitalised words that begin sentences only aren't judged. So a question is caught with other numbers or names in it.

Everything is DataFrame expressions. Items with the same template whose slots are equal to one another in the
same places form a class and are found together; each of them is reported.

Defined cases: a null text has no windows; items of fewer than five tokens have none and are found nowhere; windows
with fewer than ``LITERALS`` ordinary tokens say nothing and are left out on both sides; rows that share a doc_id are
judged each by its text; copies and repeated rows are all found; an empty table gives an empty result; columns other
than doc_id and text (item_id and text) are passed through by clean_documents() and not looked at otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, SPACE_CHARS, SPACE_CLASS, broadcast_if_small, keep, without

WINDOW = 5
LITERALS = 2
SIMILARITY = 0.8
CONSISTENCY = 0.8
#: Window hashes of the benchmark are broadcast up to this number, else joined by a shuffle.
BROADCAST_WINDOWS = 200_000

NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
PUNCTUATION = ".,;:!?\"()[]{}*#&$%|<>=_~`"
#: Units that count as such after a number, in any case.
UNITS = "kgs?|g|grams?|kilograms?|mg|lbs?|oz|ounces?|tons?|tonnes?|km|kilomet(?:er|re)s?|m|met(?:er|re)s?|cm|centimet(?:er|re)s?|mm|mi|miles?|ft|foot|feet|in|inch|inches|yards?|yds?|l|ml|lit(?:er|re)s?|gallons?|s|secs?|seconds?|mins?|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|mph|kmh|percent|dollars?|euros?|pounds?|cents?|degrees?"
NAMED = r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})(?<![\p{L}\p{N}]['’-]\p{Lu})[\p{L}'’-]*+"
#: Names that don't begin a sentence.
WITHIN = rf"\p{{Lu}}(?<=[\p{{L}}\p{{N}},;][{SPACE_CLASS}]\p{{Lu}})[\p{{L}}'’-]*+"
NUMBERED = r"[0-9](?<![\p{L}\p{N}][0-9])[0-9]*+(?:[.,:/][0-9]++)*+"
WITH_UNIT = f"(?i){NUMBER}([{SPACE_CLASS}]*+)(?:{UNITS})(?![\\p{{L}}\\p{{N}}])"


def _bare(c: Column) -> Column:
    return F.trim(F.translate(c, PUNCTUATION, ""), F.lit(SPACE_CHARS))


def _split(bare: Column) -> Column:
    return F.split(F.lower(bare), f"[{SPACE_CLASS}]+")


def _forms(text: Column) -> Column:
    """array<struct<named, plain>> of the tokens in both forms: one element, or none for a text without tokens. What
    stands in a one-element array is made once and not once a use in the lambda."""
    typed = F.regexp_replace(F.regexp_replace(text, NUMBERED, NUMBER), WITH_UNIT, f"{NUMBER}$1{UNIT}")
    bare = F.filter(F.array(_bare(typed)), lambda b: b != "")
    return F.transform(bare, lambda b: F.struct(_split(F.regexp_replace(b, NAMED, NAME)).alias("named"), _split(b).alias("plain")))


def _hash(form: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(form, i + j) for j in range(WINDOW)])


def windows(table: DataFrame, *keys: str) -> DataFrame:
    """keys and h (hash) of the distinct windows of both forms. The hashes are made as one array a row, so that neither
    text nor tokens are carried along with each window."""

    def hashed(form: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(form) - WINDOW), lambda i: _hash(form, i))

    both = lambda f: F.when(f["named"] == f["plain"], hashed(f["named"])).otherwise(F.concat(hashed(f["named"]), hashed(f["plain"])))
    hashes = F.transform(_forms(F.coalesce("text", F.lit(""))), lambda f: F.when(F.size(f["named"]) >= WINDOW, both(f)))
    return table.select(*keys, F.explode(F.array_distinct(F.get(hashes, F.lit(0)))).alias("h"))


def slotted_windows(table: DataFrame, *keys: str) -> DataFrame:
    """keys, i (place), named and plain, each the hash h and slots (the placeholders) of the window; for few rows."""
    text = F.coalesce("text", F.lit(""))
    # placeholders replace characters within tokens only, so both token lists run alongside
    tokens = F.transform(_forms(text), lambda f: F.struct(f["named"].alias("named"), f["plain"].alias("plain"), _split(_bare(text)).alias("raw")))

    def window(t: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), *[F.struct(_hash(t[c], i).alias("h"), _slots(t[c], t["raw"], i).alias("slots")).alias(c) for c in ("named", "plain")])

    rows = F.transform(tokens, lambda t: F.when(F.size(t["named"]) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(t["named"]) - WINDOW), lambda i: window(t, i))))
    return table.select(*keys, F.explode(F.get(rows, F.lit(0))).alias("w")).select(*keys, "w.*")


def _value(kind: Column, raw: Column) -> Column:
    """A slot's value; units are in the singular."""
    one = F.regexp_replace(F.regexp_replace(raw, "(?<=inch)es$|(?<=[a-z]{2})s$", ""), "feet$", "foot")
    return F.when(kind.contains(UNIT), one).otherwise(raw)


def _slots(form: Column, raw: Column, i: Column) -> Column:
    """array<struct<j, kind, value>> of the placeholders in the window at i."""
    pairs = F.zip_with(F.slice(form, i + 1, WINDOW), F.slice(raw, i + 1, WINDOW), lambda c, v: F.struct(c.alias("kind"), _value(c, v).alias("value")))
    pairs = F.transform(pairs, lambda p, j: F.struct(j.alias("j"), p["kind"].alias("kind"), p["value"].alias("value")))
    return F.filter(pairs, lambda p: p["kind"].rlike(f"[{NUMBER}{NAME}{UNIT}]"))


def _marks(form: Column, raw: Column) -> Column:
    """The placeholders of a whole text in order, each with its value."""
    pairs = F.zip_with(form, raw, lambda c, v: F.struct(c.alias("kind"), _value(c, v).alias("value")))
    return F.transform(F.filter(pairs, lambda p: p["kind"].rlike(f"[{NUMBER}{UNIT}]")), lambda p: F.concat_ws(" ", p["kind"], p["value"]))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """cls, items (the class's item ids), i, w (of the window in both forms), typed (whether it is informative with its
    names as placeholders), h and slots of the informative windows in either form, once for each class of items with equal
    templates whose slots are equal to one another in the same places."""
    b = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("item_id").isNotNull())
    b = b.select("item_id", "text", F.explode(_forms(F.col("text"))).alias("form"))
    b = b.select("item_id", "text", "form", F.explode(F.array(_marks(F.col("form.plain"), _split(_bare(F.col("text")))))).alias("marks"))
    pattern = F.transform("marks", lambda m: F.array_position(F.col("marks"), m))
    b = b.withColumn("cls", F.xxhash64(F.array_join("form.named", " "), F.array_join("form.plain", " "), pattern))
    first = b.groupBy("cls").agg(F.min("text").alias("text"), F.array_sort(F.collect_set("item_id")).alias("items"))
    names = F.transform(F.regexp_extract_all("text", F.lit(WITHIN), F.lit(0)), lambda n: F.lower(n))
    w = slotted_windows(first.withColumn("names", names), "cls", "items", "names")
    tells = lambda c: WINDOW - F.size(F.col(c)["slots"]) >= LITERALS
    forms = F.array(F.when(tells("named"), F.col("named")), F.when(tells("plain") & (F.col("named.h") != F.col("plain.h")), F.col("plain")))
    w = w.select("cls", "items", "names", "i", F.xxhash64("named.h", "plain.h").alias("w"), tells("named").alias("typed"), F.explode(forms).alias("f")).where(F.col("f").isNotNull())
    judged = lambda s: ~s["kind"].contains(NAME) | F.array_contains(F.col("names"), s["value"])
    slots = F.transform("f.slots", lambda s: F.struct(s["j"].alias("j"), s["kind"].alias("kind"), s["value"].alias("value"), judged(s).alias("judged")))
    return w.select("cls", "items", "i", "w", "typed", "f.h", slots.alias("slots"))


def found(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, consistency: float = CONSISTENCY) -> DataFrame:
    """doc_id, th (hash of the text), cls, items, n_matched, n_windows, coverage and consistency of the classes of items
    found. The documents' windows are hashed and met with the benchmark's where they are made,
    and only those that are in it go on."""
    items = keep(item_windows(benchmark), "items")
    known, _ = broadcast_if_small(items.select("h").distinct(), BROADCAST_WINDOWS)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64(text).alias("th"))
    hits = windows(rows, "doc_id", "th").join(known, "h").select("doc_id", "th", "h")
    has_judged = F.exists("slots", lambda o: o["judged"])
    n_windows = [F.count_distinct("w").alias("n_windows"), F.count_distinct(F.when(F.col("typed"), F.col("w"))).alias("n_typed")]
    sizes = items.groupBy("cls").agg(*n_windows, F.first("items").alias("items"), F.count_distinct(F.when(has_judged, F.col("i"))).alias("n_slotted"))
    of_item = items.select("cls", "w", "typed", "h").distinct()
    # one row for each window of a document, whatever its repeats, and one for each of an item, whatever its form
    once = hits.select("doc_id", "th", "h").distinct()
    side, _ = broadcast_if_small(of_item, BROADCAST_WINDOWS)
    cover = once.join(side, "h").select("doc_id", "th", "cls", "w", "typed").distinct().groupBy("doc_id", "th", "cls").agg(F.count("*").alias("n_both"), F.count_if("typed").alias("m_typed"))
    # all windows, or those alone that say something without their names, whichever are covered better
    cover = cover.join(sizes, "cls").withColumn("better", F.col("m_typed") * F.col("n_windows") > F.col("n_both") * F.col("n_typed"))
    cover = cover.withColumn("n_matched", F.when(F.col("better"), F.col("m_typed")).otherwise(F.col("n_both"))).withColumn("n_windows", F.when(F.col("better"), F.col("n_typed")).otherwise(F.col("n_windows")))
    cover = cover.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= similarity)
    cover = keep(cover, "cover")
    slotted = items.where(has_judged).select("cls", "h", F.col("i").alias("at"), F.col("slots").alias("own"))
    slotted, _ = broadcast_if_small(slotted, BROADCAST_WINDOWS)
    # slots are looked up in the texts of candidates only, once for each text
    texts, _ = broadcast_if_small(cover.select("th").distinct())
    there = rows.join(texts, "th").groupBy("th").agg(F.max("text").alias("text"))
    looked = slotted_windows(there, "th").select("th", "i", F.explode(F.array_distinct(F.array("named", "plain"))).alias("f")).select("th", "i", "f.h", "f.slots")
    pairs = looked.where(F.size("slots") > 0).join(slotted, "h")
    pairs = pairs.join(cover.select("th", "cls").distinct(), ["th", "cls"])
    pairs = pairs.select("th", "cls", "at", (F.col("i") - F.col("at")).alias("shift"), F.explode(F.zip_with("own", "slots", lambda o, d: F.struct(o["j"].alias("j"), o["kind"].alias("kind"), o["value"].alias("a"), d["value"].alias("b"), o["judged"].alias("judged")))).alias("p")).where("p.judged")
    pairs = pairs.select("th", "cls", "at", "shift", "p.j", "p.kind", "p.a", "p.b").distinct()
    covered = pairs.groupBy("th", "cls", "shift").agg(F.count_distinct("at").alias("covered"))
    n = pairs.groupBy("th", "cls", "shift", "kind", "a", "b").agg(F.count("*").alias("n"))
    per_value = n.groupBy("th", "cls", "shift", "kind", "a").agg((F.max("n") / F.sum("n")).alias("share"))
    # in an alignment the least consistent value decides
    aligned = per_value.groupBy("th", "cls", "shift").agg(F.min("share").alias("consistency")).join(covered, ["th", "cls", "shift"])
    aligned = aligned.join(sizes.select("cls", "n_slotted"), "cls")
    whole = F.when(F.col("covered") >= similarity * F.col("n_slotted"), F.col("consistency"))
    fit = aligned.groupBy("th", "cls").agg(F.max(F.struct("covered", "consistency")).alias("top"), F.max(whole).alias("whole"))
    fit = fit.select("th", "cls", F.greatest("top.consistency", "whole").alias("consistency"))
    out = cover.join(fit, ["th", "cls"], "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
    return out.where(F.col("consistency") >= consistency).select("doc_id", "th", "cls", "items", "n_matched", "n_windows", "coverage", "consistency")


def report(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, coverage and consistency of every item found, once for each text; all
    items of a class are found together."""
    return found(docs, benchmark, **params).select("doc_id", F.explode("items").alias("item_id"), "n_matched", "n_windows", "coverage", "consistency")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` with all its columns, without those in which an item is found."""
    gone = found(docs, benchmark, **params)
    return without(docs, gone.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), "th"))
