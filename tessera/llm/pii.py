"""Personal data: pattern spans, and terms that give protected values away.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. Each distinct value is then a
protected entity *c*. Over the corpus, a term *t* that stands near *c* discloses it by

    PMI(c; t) = log2(N * n(c, t) / (n(c) * n(t)))      of at most      IC(c) = log2(N / n(c)),

n counting documents, n(c, t) those in which t stands within ``CONTEXT_WORDS`` words and ``CONTEXT_CHARS`` characters of
c, up to the next match of c's kind. A term whose PMI reaches ``threshold`` of IC(c), seen in at least ``min_support``
different surroundings of c, is marked wherever it occurs; from ``remove_at`` on it is removed, below that it
is generalised to a placeholder. Everything is DataFrame expressions.

Defined cases: a null text counts as empty; repeated rows and copies each count and each get their own result row (a
term's support counts different surroundings, so copies alone don't give it); an empty table gives an empty result; columns other than doc_id and text are not
looked at; a text without findings has an empty span list. Ties in the span order go by kind, in KINDS' order,
terms last. A term span that overlaps a pattern span is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, broadcast_if_small, keep

KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns. Possessive loops and the look-behinds only spare Java's matcher quadratic work on
#: long runs; ``\G`` lets a match begin where the one before it ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that a text without such a character has no match.
TRIGGERS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

SPAN = "struct<start:bigint,ord:int,kind:string,end:bigint,value:string>"
#: A span with up to CONTEXT_CHARS + 1 characters on either side.
WIDE = SPAN[:-1] + ",left:string,right:string>"
CONTEXT_CHARS = 120
CONTEXT_WORDS = 8
MIN_SUPPORT = 2
#: Up to so many spans are placed in one pass; more are placed block by block, as each step copies the list so far.
FEW = 64
THRESHOLD = 0.8
REMOVE_AT = 0.95


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(v, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(v))
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", _digits(v))
    return n.between(10, 15)


def _only_valid(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often it is used in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: Column | str, hits: Column, kind: Column, order: int) -> Column:
    """Spans of ``hits``, the matches of ``pattern``: the gaps between them give the positions and the surroundings."""

    def pairs(gaps: Column) -> Column:
        return F.transform(hits, lambda h, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), h.alias("hit"), F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS + 1)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT_CHARS + 1)).alias("right")))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), kind.alias("kind"), end.alias("end"), x["hit"].alias("value"), x["left"].alias("left"), x["right"].alias("right"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def run(p: Column, at: Column) -> Column:
        start = F.struct(at.cast("bigint").alias("at"), _empty(WIDE).alias("out"))
        return F.aggregate(p, start, add, lambda acc: acc["out"])

    def block_by_block(p: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(p))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(p), size), lambda i: F.slice(p, i, size))
        length = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda n, x: n + x["gap"] + F.length(x["hit"]))
        sized = F.transform(blocks, lambda b: F.struct(b.alias("rows"), length(b).alias("length")))
        before = lambda s, i: F.aggregate(F.slice(s, F.lit(1), i), F.lit(0).cast("bigint"), lambda n, x: n + x["length"])
        return _bound(sized, lambda s: F.flatten(F.transform(s, lambda b, i: run(b["rows"], before(s, i)))))

    few = _bound(F.split(text, pattern, -1), pairs)
    return F.when(F.size(hits) <= FEW, run(few, F.lit(0))).otherwise(_bound(few, block_by_block))


def _empty(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def _narrow(spans: Column) -> Column:
    """Spans without their surroundings."""
    return F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "ord", "kind", "end", "value")]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base (valid pattern spans in order) and around (each span's entity, window and terms)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    for kind in KINDS:
        hits = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        if TRIGGERS[kind]:
            hits = F.when(F.contains("text", F.lit(TRIGGERS[kind])), hits)
        d = d.withColumn(f"hits_{kind}", hits)
    for i, kind in enumerate(KINDS):
        spans = located(F.col("text"), PATTERNS[kind], F.col(f"hits_{kind}"), F.lit(kind), i)
        d = d.withColumn(f"spans_{kind}", F.when(F.size(f"hits_{kind}") > 0, _only_valid(kind, spans)).otherwise(_empty(WIDE)))
    d = d.withColumn("wide", F.array_sort(F.concat(*[f"spans_{k}" for k in KINDS])))
    around = F.when(F.size("wide") > 0, F.transform("wide", _window))
    return d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"), _narrow(F.col("wide")).alias("base"), around.alias("around"))


def _plain(tokens: Column) -> Column:
    """Of white-space tokens, those that are one run of letters within punctuation, as ASCII-lower terms."""
    kept = F.filter(tokens, lambda t: t.rlike(r"^[^\p{L}0-9@]*\p{L}{3,}[^\p{L}0-9@]*$"))
    return F.transform(kept, lambda t: ascii_lower(F.regexp_extract(t, r"\p{L}{3,}", 0)))


def _window(s: Column) -> Column:
    """Entity, hash of the surroundings and terms of a span; a word that the window cuts is left out."""
    words = lambda c: F.split(c, r"[\x20\x09-\x0D]+")
    left, right = words(s["left"]), words(s["right"])
    left = F.when(F.length(s["left"]) > CONTEXT_CHARS, F.slice(left, 2, F.greatest(F.size(left) - 1, F.lit(0)))).otherwise(left)
    left = F.slice(left, F.greatest(F.size(left) - CONTEXT_WORDS, F.lit(0)) + 1, CONTEXT_WORDS)
    right = F.when(F.length(s["right"]) > CONTEXT_CHARS, F.slice(right, 1, F.greatest(F.size(right) - 1, F.lit(0)))).otherwise(right)
    right = F.slice(right, 1, CONTEXT_WORDS)
    value = F.when(s["kind"] == "email", ascii_lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(_digits(s["value"]))
    tokens = F.concat(left, right)
    return F.struct(
        F.xxhash64(s["kind"], value).alias("entity"),
        F.xxhash64(F.array_join(tokens, " ")).alias("ctx"),
        F.array_distinct(_plain(tokens)).alias("terms"),
    )


def disclosing_terms(docs: DataFrame, found: DataFrame, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD, remove_at: float = REMOVE_AT) -> tuple[DataFrame, DataFrame | None]:
    """(term, ratio, action) of the terms beyond the threshold, and the spans of these terms by text_key (None if there
    are none).

    ``found`` is find()'s table. Pairs come from windows of fixed width, so their number is linear in the spans.
    Of the terms near an entity only the counts are taken over the corpus; places are looked up for those that
    pass, which are rare words by the threshold itself."""
    rows = found.where(F.size("base") > 0)
    entities = F.array_distinct(F.transform("around", lambda a: a["entity"]))
    n_entity = rows.select(F.explode(entities).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    near = rows.select(F.monotonically_increasing_id().alias("row"), F.explode("around").alias("a")).select("row", "a.entity", "a.ctx", F.explode("a.terms").alias("term"))
    pairs = near.groupBy("entity", "term").agg(F.count_distinct("ctx").alias("support"), F.count_distinct("row").alias("n_both")).where(F.col("support") >= min_support)
    n = float(found.count())
    ratio = lambda n_term: F.log2(F.lit(n) * F.col("n_both") / (F.col("n_entity") * F.col(n_term))) / F.log2(F.lit(n) / F.col("n_entity"))
    # a term stands in at least as many documents as it stands near an entity in; with that the ratio is largest,
    # so common words go before the corpus is read for counts
    n_near = near.groupBy("term").agg(F.count_distinct("row").alias("n_near"))
    pairs = pairs.join(n_entity.where(F.col("n_entity") < n), "entity").join(n_near, "term").where(ratio("n_near") >= threshold)
    pairs = keep(pairs, "pairs", few=True)
    if not pairs.limit(1).count():  # nothing discloses, so the texts needn't be read again
        return pairs.select("term", F.lit(0.0).alias("ratio"), F.lit("").alias("action")), None
    words = F.array_distinct(F.split(ascii_lower("text"), r"[^\p{L}]+"))
    text = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    terms, _ = broadcast_if_small(pairs.select("term").distinct())
    n_term = text.select(F.explode(words).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n_term"))
    scored = pairs.join(n_term, "term").select("term", ratio("n_term").alias("ratio")).groupBy("term").agg(F.max("ratio").alias("ratio"))
    action = F.when(F.col("ratio") >= remove_at, F.lit("remove")).otherwise(F.lit("generalise"))
    flagged = keep(scored.where(F.col("ratio") >= threshold).withColumn("action", action), "flagged", few=True)
    side, small = broadcast_if_small(flagged.select("term", "action"))
    key = F.md5(F.col("text").cast("binary")).alias("text_key")
    if small:  # the words meet the terms where they are made; a text is touched again only on a hit
        at = text.select("text", F.explode(words).alias("term")).join(side, "term").select(key, "term", "action", "text")
    else:
        hit = text.select(key, F.explode(words).alias("term")).join(side, "term").groupBy("text_key").agg(F.collect_set(F.struct("term", "action")).alias("terms"))
        at = text.select(key, "text").join(hit, "text_key").select("text_key", F.explode("terms").alias("t"), "text").select("text_key", "t.*", "text")
    pattern = F.concat(F.lit(r"(?<!\p{L})"), F.col("term"), F.lit(r"(?!\p{L})"))
    at = at.withColumn("low", ascii_lower("text"))
    at = at.withColumn("hits", F.regexp_extract_all("low", pattern, F.lit(0)))
    at = at.withColumn("s", located(F.col("low"), pattern, F.col("hits"), F.lit("term"), len(KINDS)))
    return flagged, at.select("text_key", F.transform(_narrow(F.col("s")), lambda s: s.withField("value", F.col("action"))).alias("s"))


def spans(docs: DataFrame, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD, remove_at: float = REMOVE_AT) -> DataFrame:
    """doc_id, text_key, base and terms: the two span lists of each row; kind is "term" for every term span and
    ``value`` holds the term's action there."""
    found = keep(find(docs), "found")
    _, at = disclosing_terms(docs, found, min_support, threshold, remove_at)
    if at is None:
        return found.select("doc_id", "text_key", "base", _empty().alias("terms"))
    by_text = at.groupBy("text_key").agg(F.flatten(F.collect_set("s")).alias("terms"))
    by_text = keep(by_text, "marked", few=True)
    out = found.select("doc_id", "text_key", "base").join(by_text, "text_key", "left")
    apart = F.filter(F.coalesce("terms", _empty()), lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (t["end"] > b["start"])))
    return out.select("doc_id", "text_key", "base", apart.alias("terms"))


def _joined(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **params) -> DataFrame:
    """The digest of spans(): counts by kind, the hash of the pattern spans, and all spans."""
    s = spans(docs, **params)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return s.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "terms"))).alias("spans"),
        F.size("terms").cast("bigint").alias("n_term"),
    )


def sanitise(docs: DataFrame, **params) -> DataFrame:
    """doc_id and text with pattern spans and generalised terms as placeholders such as <EMAIL>, and removed
    terms gone. Where spans overlap, the one that starts first stands and the rest of a later one goes with it."""
    s = spans(docs, **params).select("text_key", F.array_sort(F.concat("base", "terms")).alias("all")).dropDuplicates(["text_key"])
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.md5(F.col("text").cast("binary")))
    j = keyed.join(s, "text_key")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        gap = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when(x["start"] < acc["at"], "").when((x["kind"] == "term") & (x["value"] == "remove"), "").otherwise(F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    text = F.aggregate("all", start, add, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"))))
    return j.select("doc_id", text.alias("text"))
