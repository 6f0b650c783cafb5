"""Sources for an answer within a token budget, their citations, and what an answer says about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import page_label

HEADER_TOKENS = 30
MAX_SOURCES = 12
# Citation groups as models write them, and sentence ends in answers.
MARKER_GROUP = r"(?i)[\[(]\s*(?:S|Source\s*)\d+(?:\s*(?:,|;|and|&)\s*(?:S|Source\s*)\d+)*\s*[\])]"
ANSWER_BREAK = r"(?<!\bU\.S\.)(?<!\bInc\.)(?<!\bCo\.)(?<!\be\.g\.)(?<!\bi\.e\.)(?<!\bvs\.)(?<=[.!?])\s+(?=\[|[A-Za-z0-9$])"
REPEATED_RELEASE = r"(\[[A-Z]{1,5} Q[1-4] FY\d{4} release\])(?:[\s.]*\1)+"


def pack(hits: DataFrame, budget: int, max_sources: int = MAX_SOURCES, by: str = "query_id") -> DataFrame:
    """In rank order, every chunk that still fits (one that doesn't is passed over, not the end), each once, numbered
    source_no. A fold over the query's hits, of which a search returns a bounded number; hits need rank, id and
    token_count."""
    item = F.struct("rank", "id", F.col("token_count").cast("bigint").alias("token_count"))
    listed = hits.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("hits"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.filter(F.col("hits"), lambda h: F.lit(False)).alias("kept"))

    def step(acc: Column, h: Column) -> Column:
        cost = h["token_count"] + HEADER_TOKENS
        fits = (acc["used"] + cost <= budget) & (F.size(acc["kept"]) < max_sources) & ~F.exists(acc["kept"], lambda k: k["id"] == h["id"])
        return F.struct(F.when(fits, acc["used"] + cost).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(h))).otherwise(acc["kept"]).alias("kept"))

    packed = listed.select(by, F.aggregate("hits", start, step).alias("p"))
    return packed.select(by, F.posexplode("p.kept").alias("pos", "h"), F.col("p.used").alias("used")).select(by, (F.col("pos") + 1).alias("source_no"), "h.*", "used")


def page_of() -> Column:
    return F.coalesce(page_label(F.col("page_label_start"), F.col("page_label_end")), F.concat(F.lit("#"), F.col("page_start").cast("string")))


def citation() -> Column:
    """How a source is cited; columns of a chunk."""
    title = F.element_at(F.split("section_title", ": ", 2), -1)
    fact = F.when(F.coalesce(F.col("metadata")["series"], F.lit("false")) == "true", F.format_string("[XBRL %s %s]", "ticker", title)).otherwise(F.format_string("[XBRL %s FY%d %s]", "ticker", "fiscal_year", title))
    release = F.format_string("[%s Q%d FY%d release]", "ticker", "fiscal_quarter", "fiscal_year")
    return F.when(F.col("section") == "XBRL", fact).when(F.coalesce("fiscal_quarter", F.lit(0)) != 0, release).otherwise(F.format_string("[%s FY%d p.%s]", "ticker", "fiscal_year", page_of()))


def rendered(source_id: Column) -> Column:
    """A source as a prompt shows it."""
    fact = F.col("context")
    release = F.format_string("%s (%s) earnings release, Q%d fiscal year %d, quarter ended %s", "company", "ticker", "fiscal_quarter", "fiscal_year", "period_end")
    annual = F.format_string("%s (%s) Form 10-K, fiscal year %d, %s: %s, page %s", "company", "ticker", "fiscal_year", "section", "section_title", page_of())
    is_fact = F.col("section") == "XBRL"
    head = F.when(is_fact, fact).when(F.coalesce("fiscal_quarter", F.lit(0)) != 0, release).otherwise(annual)
    sub = F.when(is_fact, "").otherwise(F.coalesce(F.concat(F.lit(" | "), F.col("subsection")), F.lit("")))
    return F.concat(F.lit("["), source_id, F.lit("] "), head, sub, F.lit("\n"), F.col("text"))


def prompt(question: Column, sources: Column, rules: dict[str, tuple[Column, str]], system: str) -> Column:
    """array<struct<role, content>>: each rule joins the system text only if its condition holds."""
    extra = F.concat(F.lit(system), *[F.when(cond, F.lit(text)).otherwise("") for cond, text in rules.values()])
    user = F.concat(F.lit("Sources:\n\n"), F.array_join(sources, "\n\n"), F.lit("\n\nQuestion: "), question)
    return F.array(F.struct(F.lit("system").alias("role"), extra.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def normalize_markers(text: Column) -> Column:
    """Citation groups of any style become [S1][S2]. The text is cut at the groups and put together again."""
    groups = F.regexp_extract_all(text, F.lit(MARKER_GROUP), F.lit(0))
    plain = F.transform(groups, lambda g: F.array_join(F.transform(F.regexp_extract_all(g, F.lit(r"(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("[S"), n, F.lit("]"))), ""))
    return F.array_join(F.flatten(F.zip_with(F.split(text, MARKER_GROUP, -1), plain, lambda t, m: F.array(t, F.coalesce(m, F.lit(""))))), "")


def render_citations(text: Column, citations: Column) -> Column:
    """[S1] becomes the source's citation (a map by id); unknown ids stay; a release cited twice running is cited once."""
    marker = r"\[(S\d+)\]"
    ids = F.regexp_extract_all(text, F.lit(marker), F.lit(1))
    shown = F.transform(ids, lambda i: F.coalesce(F.try_element_at(citations, i), F.concat(F.lit("["), i, F.lit("]"))))
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, marker, -1), shown, lambda t, c: F.array(t, F.coalesce(c, F.lit(""))))), "")
    return F.regexp_replace(joined, REPEATED_RELEASE, "$1")


def claims(answer: Column) -> Column:
    """array<struct<text, ids>> of the sentences of an answer. A sentence has the markers in it and those that lead the
    next; one without takes those of the next cited sentence of its line."""
    lines = F.filter(F.split(normalize_markers(F.trim(answer)), "\n"), lambda s: F.trim(s) != "")
    return F.flatten(F.transform(lines, _line_claims))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often it is used in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _line_claims(line: Column) -> Column:
    marker = r"\[(S\d+)\]"
    lead = lambda p: F.regexp_extract(F.coalesce(p, F.lit("")), r"^((?:\s*\[S\d+\])+)", 1)

    def raw(parts: Column) -> Column:
        return F.transform(
            parts,
            lambda p, i: F.struct(
                F.trim(F.regexp_replace(p, marker, "")).alias("text"),
                F.array_distinct(F.regexp_extract_all(F.concat(p, lead(F.get(parts, i + 1))), F.lit(marker), F.lit(1))).alias("ids"),
            ),
        )

    def filled(said: Column) -> Column:
        cited = F.filter(F.transform(said, lambda c, i: F.struct(i.alias("at"), c["ids"].alias("ids"))), lambda c: F.size(c["ids"]) > 0)
        own_or_next = lambda cited, i: F.coalesce(F.get(F.filter(cited, lambda x: x["at"] >= i), F.lit(0))["ids"], F.array().cast("array<string>"))
        return _bound(cited, lambda x: F.transform(said, lambda c, i: F.struct(c["text"].alias("text"), own_or_next(x, i).alias("ids"))))

    parts = F.filter(F.split(F.trim(line), ANSWER_BREAK), lambda p: F.trim(p) != "")
    return _bound(F.filter(_bound(parts, raw), lambda c: c["text"].rlike(r"[\p{L}\p{N}]")), filled)


def confidence(n_claims: Column, n_supported: Column, best_score: Column, any_repaired: Column, abstained: Column) -> Column:
    """high: all claims hold, one source is strong, none was re-attributed; medium: half hold; else low."""
    share = F.try_divide(n_supported, n_claims)
    return (
        F.when(abstained | (n_claims == 0), "none")
        .when((share == 1) & (F.coalesce(best_score, F.lit(0.0)) >= 0.5) & ~any_repaired, "high")
        .when(share >= 0.5, "medium")
        .otherwise("low")
    )


def finalize(answers: DataFrame) -> DataFrame:
    """Of answers (text, abstained, verified array<struct<status, ids>>, citations): abstain if no claim holds, add
    citations that the text lacks, render."""
    good = F.filter("verified", lambda v: v["status"] == "supported")
    cited = F.array_distinct(F.flatten(F.transform(good, lambda v: v["ids"])))
    a = answers.withColumns({"abstained": F.col("abstained") | (F.size(good) == 0), "cited": cited})
    missing = F.filter("cited", lambda i: ~F.contains(F.col("text"), F.concat(F.lit("["), i, F.lit("]"))))
    full = F.when(F.size(missing) > 0, F.concat(F.col("text"), F.lit(" "), F.array_join(F.transform(missing, lambda i: F.concat(F.lit("["), i, F.lit("]"))), ""))).otherwise(F.col("text"))
    return a.withColumn("answer", F.when(F.col("abstained"), "").otherwise(render_citations(full, F.col("citations"))))


def cache_key(provider: Column, model: Column, messages: Column, schema: Column) -> Column:
    """A request's key: equal requests have equal keys."""
    return F.sha2(F.to_json(F.struct(provider.alias("provider"), model.alias("model"), messages.alias("messages"), schema.alias("schema"))).cast("binary"), 256)
