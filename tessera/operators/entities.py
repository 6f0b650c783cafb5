"""Rule-based reading of questions: companies, years, quarters, sections, scope; and follow-ups over conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Years covered, names of companies, and cue patterns.
YEARS = (2022, 2023, 2024, 2025)
ALIASES = {
    "AAPL": "apple|iphone|ipad|macbook|app store|applecare|aapl",
    "MSFT": "microsoft|azure|activision|linkedin|xbox|microsoft cloud|intelligent cloud|github|msft",
    "NVDA": "nvidia|geforce|blackwell|hopper|cuda|nvda",
    "AMZN": "amazon|aws|amazon web services|amzn",
    "GOOGL": "alphabet|google|youtube|waymo|google cloud|googl",
    "META": "meta|facebook|instagram|whatsapp|reality labs|family of apps",
    "TSLA": "tesla|cybertruck|robotaxi|model y|model 3|tsla",
    "JPM": "jpmorgan|jp morgan|jpmorgan chase|chase|jpm",
    "V": "visa",
    "MA": "mastercard",
}
YEAR_END_MONTH = {"AAPL": 9, "MSFT": 6, "NVDA": 1, "V": 9}
SECTION_CUES = {"Item 1A": r"(?i)\brisks?\b|\brisk factors?\b", "Item 1C": r"(?i)\bcybersecurity\b"}
YEAR = r"(?<![\d$.,])(19\d{2}|20\d{2})(?!\d|,\d|\.\d|%)"
RANGE = r"(?i)\b(?:from|between)\s+(?:fiscal\s+(?:year\s+)?)?(20\d{2})\s+(?:to|and|through|-)\s+(?:fiscal\s+(?:year\s+)?)?(20\d{2})\b"
LAST_N = r"(?i)\b(?:last|past|previous)\s+(two|three|four|2|3|4)\s+(?:fiscal\s+)?years\b"
LATEST = r"(?i)\b(?:latest|most recent|this)\s+(?:fiscal\s+)?year\b|\blatest\b"
PRIOR = r"(?i)\b(?:the\s+)?(?:year|fiscal year)\s+before\b|\bprior\s+year\b|\bprevious\s+year\b"
SAME = r"(?i)\b(?:that|the same)\s+(?:fiscal\s+)?year\b"
SHORT_YEAR = r"(?i)(?:(?<![A-Za-z])FY\s?'?|\bQ[1-4]\s?'|\b[1-4]Q\s?'?)(\d{2})\b"
QUARTER = r"(?i)\bQ([1-4])(?=\b|FY)|\b([1-4])Q(?:\d{2})?\b|\b(first|second|third|fourth|1st|2nd|3rd|4th)[- ]quarter\b"
BY_QUARTER = r"(?i)\bquarterly\b(?!\s+(?:cash\s+)?dividends?)|\b(?:each|every|by|per)\s+(?:fiscal\s+)?quarter\b|\bquarter[- ](?:over|by|to)[- ]quarter\b|\b(?:last|past)\s+four\s+quarters\b"
RELEASE_CUE = r"(?i)\b(?:earnings|press|results)\s+release\b|\bearnings\s+(?:report|announcement)\b|\bthree months ended\b|\bquarter ended\b"
GUIDANCE = r"(?i)\bguidance\b|\boutlook\b|\bguid(?:e|ed|ing)\b|\bforecast|\bexpect(?:ed|s)?\b"
MONTHS = "january february march april may june july august september october november december".split()
QUARTER_DATE = rf"(?i)\b(?:three months|quarter)\s+ended\s+({'|'.join(MONTHS)})\s+(?:(\d{{1,2}}),?\s+)?(20\d{{2}})\b"
LIVE_TIME = r"(?i)\b(?:current(?:ly)?|today'?s?|right now|now|at the moment|live|real[- ]time|this (?:week|month))\b"
MARKET = r"(?i)\b(?:(?:stock|share) price|price per share|share price|market (?:cap|capitalization|value)|trading (?:at|price)|(?:stock|shares?) (?:is |are )?trad(?:e|es|ing)|stock quote)\b"
BACK_REFERENCE = r"(?i)\b(?:its|it|they|their|them|that|those|these|this|same|also|too|else)\b|^\s*(?:and|how about|what about)\b"
NUMBER_WORDS = {"first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3, "fourth": 4, "4th": 4, "two": 2, "three": 3, "four": 4}

INTS = "array<int>"


def _none() -> Column:
    return F.array().cast(INTS)


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _number(word: Column) -> Column:
    return F.coalesce(word.try_cast("int"), F.element_at(_map(NUMBER_WORDS), F.lower(word)))


def tickers(text: Column) -> Column:
    """Companies named, in the order of their first mention."""
    at = [F.struct(F.regexp_instr(text, F.lit(rf"(?i)\b(?:{a})\b")).alias("at"), F.lit(t).alias("t")) for t, a in ALIASES.items()]
    return F.transform(F.array_sort(F.filter(F.array(*at), lambda x: x["at"] > 0)), lambda x: x["t"])


def all_years(text: Column) -> Column:
    """Every year meant, sorted: named, within a range, short (FY25), of "the last N years", and the latest only if no
    other is."""
    named = F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    spans = F.transform(F.regexp_extract_all(text, F.lit(RANGE), F.lit(0)), lambda r: F.regexp_extract_all(r, F.lit(r"(20\d{2})"), F.lit(1)))
    ranges = F.flatten(F.transform(spans, lambda s: F.sequence(F.array_min(s).cast("int"), F.array_max(s).cast("int"))))
    short = F.transform(F.regexp_extract_all(text, F.lit(SHORT_YEAR), F.lit(1)), lambda y: (F.lit(2000) + y.cast("int")).cast("int"))
    found = F.array_union(F.array_union(named, ranges), short)
    n = _number(F.regexp_extract(text, LAST_N, 1))
    corpus = F.array(*[F.lit(y) for y in YEARS])
    last_n = F.slice(corpus, F.lit(len(YEARS)) - n + 1, n)
    latest = F.array(F.lit(YEARS[-1]))
    out = F.when(text.rlike(LAST_N), F.array_union(found, last_n)).when(text.rlike(LATEST) & (F.size(found) == 0), latest).otherwise(found)
    return F.array_sort(F.array_distinct(out))


def inside(years: Column) -> Column:
    return F.filter(years, lambda y: y.isin(*YEARS))


def outside(years: Column) -> Column:
    return F.filter(years, lambda y: ~y.isin(*YEARS))


def relative_year(text: Column) -> Column:
    return F.when(text.rlike(PRIOR), "prior").when(text.rlike(SAME), "same")


def sections(text: Column) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(s)) for s, p in SECTION_CUES.items()]), lambda x: x.isNotNull())


def quarters(text: Column) -> Column:
    """Quarters named; all four for a question by quarter."""
    raw = F.regexp_extract_all(text, F.lit(QUARTER), F.lit(0))
    digit = lambda m: F.regexp_extract(m, r"(?i)^(?:Q([1-4])|([1-4])Q)", 0)
    named = F.transform(raw, lambda m: F.when(digit(m) != "", F.regexp_extract(digit(m), r"[1-4]", 0).cast("int")).otherwise(_number(F.regexp_extract(m, r"(?i)^(\w+)", 1))))
    named = F.array_sort(F.array_distinct(named))
    every = F.when(text.rlike(BY_QUARTER), F.array(*[F.lit(q) for q in (1, 2, 3, 4)])).otherwise(_none())
    return F.when(F.size(named) > 0, named).otherwise(every)


def fiscal_period(ticker: Column, month: Column, day: Column, year: Column) -> Column:
    """struct<fiscal_year, quarter> of a period's end by the company's calendar. A year of 52 or 53 weeks may end in the
    first days of the next month."""
    early = day <= 7
    m = F.when(early, F.when(month > 1, month - 1).otherwise(12)).otherwise(month)
    y = F.when(early & (month == 1), year - 1).otherwise(year)
    end = F.coalesce(F.element_at(_map(YEAR_END_MONTH), ticker), F.lit(12))
    return F.struct(F.when(m <= end, y).otherwise(y + 1).cast("int").alias("fiscal_year"), (F.floor(F.pmod(m - end - 1, F.lit(12)) / 3) + 1).cast("int").alias("quarter"))


def extract(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds tickers, fiscal_years, out_of_range_years, relative_year, fiscal_quarters, release and sections."""
    t = F.col(text)
    q = questions.withColumns({"tickers": tickers(t), "__years": all_years(t), "__quarters": quarters(t), "relative_year": relative_year(t)})
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(t, QUARTER_DATE, 1))).cast("int")
    day = F.coalesce(F.regexp_extract(t, QUARTER_DATE, 2).try_cast("int"), F.lit(15))
    year = F.regexp_extract(t, QUARTER_DATE, 3).try_cast("int")
    dated = t.rlike(QUARTER_DATE) & (F.size("tickers") == 1)
    period = fiscal_period(F.get("tickers", F.lit(0)), month, day, year)
    guided = (F.size("__quarters") == 1) & t.rlike(GUIDANCE) & ~t.rlike(RELEASE_CUE)
    one = F.get("__quarters", F.lit(0))
    q = q.withColumns({"__dated": dated, "__period": F.when(dated, period), "__guided": guided, "__calendar": year})
    # an outlook for a quarter stands in the release of the quarter before
    earlier = F.transform("__years", lambda y: y - 1)
    by_date = F.array_sort(F.array_union(F.array_remove("__years", F.col("__calendar")), F.array(F.col("__period.fiscal_year"))))
    years = F.when(F.col("__dated"), by_date).when(F.col("__guided") & (one == 1), earlier).otherwise(F.col("__years"))
    quarter = F.when(F.col("__dated"), F.array(F.col("__period.quarter"))).when(F.col("__guided"), F.array(F.when(one > 1, one - 1).otherwise(4).cast("int"))).otherwise(F.col("__quarters"))
    q = q.withColumns({"__y": years, "fiscal_quarters": quarter})
    release = (F.size("fiscal_quarters") > 0) | t.rlike(RELEASE_CUE)
    q = q.withColumns({"fiscal_years": inside(F.col("__y")), "out_of_range_years": outside(F.col("__y")), "release": release})
    q = q.withColumn("sections", F.when(F.col("release"), F.array().cast("array<string>")).otherwise(sections(t)))
    return q.drop("__years", "__quarters", "__dated", "__period", "__guided", "__calendar", "__y")


def scope(extracted: DataFrame, text: str = "question") -> DataFrame:
    """out_of_range if only years beyond the corpus are named, live_data for market data of the moment."""
    t = F.col(text)
    out = (F.size("out_of_range_years") > 0) & (F.size("fiscal_years") == 0)
    return extracted.withColumn("scope", F.when(out, "out_of_range").when(t.rlike(LIVE_TIME) & t.rlike(MARKET), "live_data").otherwise("in_corpus"))


def standalone(text: Column) -> Column:
    """Names a company and a year and doesn't refer back (columns of extract())."""
    return (F.size("tickers") > 0) & (F.size("fiscal_years") > 0) & F.col("relative_year").isNull() & ~text.rlike(BACK_REFERENCE)


def follow_ups(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """User turns (key, order, role, text) with what they take over from the conversation: the subject is the last
    earlier user turn that names a company or a year."""
    u = extract(turns.where("role = 'user'"), text)
    names = (F.size("tickers") > 0) | (F.size("fiscal_years") > 0)
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    fields = F.struct("tickers", "fiscal_years", "fiscal_quarters")
    u = u.withColumn("subject", F.last(F.when(names, fields), ignorenulls=True).over(before)).withColumn("first", F.row_number().over(W.partitionBy(key).orderBy(order)) == 1)
    alone = F.col("first") | standalone(F.col(text))
    years = F.when(F.col("relative_year") == "prior", F.filter(F.transform("subject.fiscal_years", lambda y: y - 1), lambda y: y.isin(*YEARS))).otherwise(F.col("subject.fiscal_years"))
    take = lambda own, other: F.when(alone | (F.size(own) > 0), F.col(own)).otherwise(F.coalesce(other, F.col(own)))
    keeps_quarter = alone | (F.size("fiscal_quarters") > 0) | (F.size("fiscal_years") > 0) | F.col("release")
    return u.select(
        key,
        order,
        text,
        take("tickers", F.col("subject.tickers")).alias("tickers"),
        take("fiscal_years", years).alias("fiscal_years"),
        F.when(keeps_quarter, F.col("fiscal_quarters")).otherwise(F.coalesce("subject.fiscal_quarters", "fiscal_quarters")).alias("fiscal_quarters"),
        (~alone & (F.size("tickers") == 0) & F.col("subject").isNotNull()).alias("carried"),
    )
