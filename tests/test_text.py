"""Text, figures, tables and periods against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import figures, numbers, percentiles, periods, tables, text
from tessera.functions.stemmer import stem


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "want"),
    [("revenues", "revenu"), ("consigned", "consign"), ("knightly", "knight"), ("generalizations", "general"), ("hopping", "hop"), ("hoping", "hope"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("kiwis", "kiwi"), ("skies", "sky"), ("dying", "die"), ("news", "news"), ("agreed", "agre"), ("feed", "feed"), ("happily", "happili"), ("sensational", "sensat"), ("by", "by"), ("say", "say"), ("enjoying", "enjoy"), ("luxuriated", "luxuri"), ("communism", "communism"), ("adoption", "adopt"), ("bill", "bill"), ("controlling", "control")],
)
def test_stemmer(word, want):
    assert stem(word) == want


def test_tokens(spark):
    got = one(spark, text.tokens(F.col("t")), t="The Company’s 10-K: revenues of $416,161 rose 3.5% in Item 7A, naïve")
    assert got == ["10-k", "revenu", "416,161", "rose", "3.5", "item", "7a", "na", "ve"]
    assert one(spark, text.tokens(F.col("t"), stemmed=False), t="") == []


def test_sentences_and_spaces(spark):
    assert one(spark, text.sentences(F.col("t")), t="One. Two; (three) ok? four. $5 more") == ["One.", "Two;", "(three) ok? four.", "$5 more"]
    assert one(spark, text.normalize_ws(F.col("t")), t=" a  b\n\tc ") == "a b c"
    assert one(spark, text.normalize_quotes(F.col("t")), t="“a”  ’s – b") == "\"a\" 's - b"


CASES = [
    ("$109.2 billion", "109,217", True),
    ("$109.2 billion", "109,317", False),
    ("14%", "14", True),
    ("14%", "14%", True),
    ("14.0%", "14.4%", False),
    ("14%", "14.4%", True),
    ("2.7 billion", "2,675 million", True),
    ("0", "0", True),
    ("$37.7B", "37,705", True),
    ("5 thousand", "5,000", True),
]


@pytest.mark.parametrize(("claim", "source", "want"), CASES)
def test_figures_match(spark, claim, source, want):
    assert figures.figures(claim)[0].is_in(figures.figures(source)[0]) is want
    got = one(spark, numbers.matches(F.get(numbers.figures(F.col("a")), F.lit(0)), F.get(numbers.figures(F.col("b")), F.lit(0))), a=claim, b=source)
    assert got is want


def test_figures_agree_in_both_forms(spark):
    t = "In 2024 net income was $1,234.5 million (up 12.5%), or (3) of 7B; 2,025 units, 1990 alone, v2.0 and 0.5 percent in 19"
    want = [(f.value, f.decimals, f.scale, f.percent) for f in figures.figures(t)]
    got = [(n.value, n.decimals, n.scale, n.percent) for n in one(spark, numbers.figures(F.col("t")), t=t)]
    assert got == want and (1234.5, 1, 1e6, False) in want and all(v[0] != 2024 for v in want)


def test_derived_sums():
    assert [f.value for f in figures.derived("12% + 11% + 11% = 34% but 1 + 1 = 3")] == [34.0]
    assert figures.derived("$5 billion - $2 billion = $3 billion")[0].amount == 3e9


def test_rounding_like_python(spark):
    values = [2.675, 0.285, 1.005, 0.5, 1.5, 2.5, 1234567.125, 0.125, 99.995]
    rows = spark.createDataFrame([(v, d) for v in values for d in (0, 1, 2)], "v double, d int")
    for r in rows.select("v", "d", numbers.round_like_python(F.col("v"), F.col("d")).alias("x")).collect():
        assert r.x == round(r.v, r.d)


def test_values_in_words(spark):
    f = lambda v, u: one(spark, numbers.format_value(F.lit(v), F.lit(u)))
    assert f(416161000000.0, "USD") == "$416,161 million" and f(7.46, "USD/shares") == "$7.46 per share" and f(1200.0, "shares") == "1,200 shares"
    assert one(spark, numbers.direction(numbers.change_pct(F.lit(101.0), F.lit(100.0)))) == "up"
    assert one(spark, numbers.direction(numbers.change_pct(F.lit(1.0), F.lit(0.0)))) == "-"


def test_percentiles(spark):
    d = spark.createDataFrame([(float(v),) for v in (5, 1, 4, 2)], "v double")
    r = d.agg(percentiles.median(F.col("v")).alias("a"), percentiles.at_floor(F.col("v"), 0.95).alias("b"), percentiles.at_share(F.col("v"), 0.5).alias("c"), percentiles.interpolated(F.col("v"), 0.95).alias("d")).first()
    assert (r.a, r.b, r.c) == (3.0, 4.0, 4.0) and abs(r.d - 4.85) < 1e-9


def test_tables():
    grid = [["", "2025", "", "", "2024", ""], ["Net sales", "$", "416,161", "", "$", "391,035"], ["Margin", "", "(12", ")%", "", "11%"], ["", "", "", "", "", ""]]
    rows = tables.clean([list(r) for r in grid])
    assert rows[1] == ["Net sales", "$416,161", "$391,035"] and rows[2] == ["Margin", "(12)%", "11%"] and len(rows) == 3
    assert tables.header_rows(rows) == 1 and not tables.is_layout(rows)
    assert tables.markdown(rows, 1).split("\n")[1] == "|---|---|---|"
    assert tables.is_layout([["•", "text"], ["•", "more"]]) and tables.layout_lines([["•", "text"], ["a", "b", "c"]]) == ["• text", "a | b | c"]
    assert tables.clean([]) == []


def test_table_column(spark):
    assert one(spark, tables.clean_column(F.array(F.array(F.lit("a"), F.lit("$"), F.lit("5")), F.array(F.lit("b"), F.lit(""), F.lit("6"))))) == [["a", "$5"], ["b", "6"]]


def test_periods():
    assert periods.label("Q1-2024") == (1, 2024) and periods.label("3Q22") == (3, 2022) and periods.label("30-Jun-24") == (2, 2024) and periods.label("YoY") is None
    assert periods.fiscal("NVDA", 10, 27, 2024) == (3, 2025) and periods.fiscal("AAPL", 12, 28, 2024) == (1, 2025) and periods.fiscal("TSLA", 1, 3, 2025) == (4, 2024)
    chunk = {"text": "Title Q1-2024 Q2-2024 YoY\nRevenue 21,301 25,500 20%", "chunk_type": "table", "ticker": "TSLA", "fiscal_year": 2024, "fiscal_quarter": 2, "period_end": "2024-06-30"}
    is_it = lambda n: lambda cell: cell == n
    assert periods.of_figure("Revenue 21,301 25,500 20%", chunk, is_it("25,500")) == {(2, 2024)}
    assert periods.of_figure("Revenue 21,301 25,500 20%", chunk, is_it("20%")) is None
