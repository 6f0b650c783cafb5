"""Figures in text, and their comparison across units and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A figure with its unit, and the units' scales.
FIGURE = r"(?i)(?<![\w.])\$?\(?(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?\)?(\s*(?:%|percent|billion|million|thousand|bn|mn)|[BM]\b)?"
SCALES = {"billion": 1e9, "bn": 1e9, "b": 1e9, "million": 1e6, "mn": 1e6, "m": 1e6, "thousand": 1e3}
REPORTING_SCALES = (1.0, 1e3, 1e6, 1e9)
NUMBER = "struct<value:double,decimals:int,scale:double,percent:boolean,raw:string>"


def figures(text: Column) -> Column:
    """array<NUMBER> of the figures in a text; bare whole numbers from 1990 to 2035 are years and left out."""
    raw = F.regexp_extract_all(text, F.lit(FIGURE), F.lit(0))

    def parse(r: Column) -> Column:
        whole = F.regexp_extract(r, r"(\d{1,3}(?:,\d{3})+|\d+)", 1)
        fraction = F.regexp_extract(r, r"\d(\.\d+)", 1)
        unit = F.lower(F.regexp_extract(r, r"(?i)(%|percent|billion|million|thousand|bn|mn|[BM])\s*$", 1))
        scale = F.coalesce(*[F.when(unit == u, F.lit(s)) for u, s in SCALES.items()], F.lit(1.0))
        return F.struct(
            F.concat(F.replace(whole, F.lit(","), F.lit("")), fraction).cast("double").alias("value"),
            F.greatest(F.length(fraction) - 1, F.lit(0)).alias("decimals"),
            scale.alias("scale"),
            unit.isin("%", "percent").alias("percent"),
            F.trim(r).alias("raw"),
            (F.contains(whole, F.lit(",")) | (fraction != "") | (unit != "")).alias("marked"),
        )

    parsed = F.filter(F.transform(raw, parse), lambda n: n["marked"] | ~n["value"].between(1990, 2035))
    return F.transform(parsed, lambda n: n.dropFields("marked"))


def round_like_python(x: Column, digits: Column) -> Column:
    """Half-even on the exact binary value, for non-negative and negative doubles and up to nine digits."""
    by_digits = [F.when(digits == d, F.regexp_replace(F.format_number(x, d), ",", "").cast("double")) for d in range(10)]
    return F.coalesce(*by_digits, x)


def matches(claim: Column, source: Column) -> Column:
    """Is the claim's figure the source's, allowing for rounding and for units that a table leaves out? Percent and
    plain figures agree only as written."""
    as_written = claim["value"] == source["value"]

    def at(scale: Column) -> Column:
        value = source["value"] * scale
        rounded = round_like_python(value / claim["scale"], claim["decimals"]) == round_like_python(claim["value"], claim["decimals"])
        return F.when(value == 0, claim["value"] == 0).otherwise(rounded)

    unscaled = at(F.lit(1.0))
    for s in REPORTING_SCALES[1:]:
        unscaled = unscaled | at(F.lit(s))
    scaled = F.when(source["scale"] != 1, at(source["scale"])).otherwise(unscaled)
    return F.when(claim["percent"] != source["percent"], as_written).otherwise(scaled)


def stated_in(claim: Column, sources: Column) -> Column:
    """Does any figure of the array match?"""
    return F.exists(sources, lambda s: matches(claim, s))


def format_value(value: Column, unit: Column) -> Column:
    """Figures as filings print them: dollars in millions, amounts a share with cents, others whole."""
    return (
        F.when(unit == "USD", F.concat(F.lit("$"), F.format_number(value / 1e6, 0), F.lit(" million")))
        .when(unit == "USD/shares", F.concat(F.lit("$"), F.format_number(value, 2), F.lit(" per share")))
        .otherwise(F.concat(F.format_number(value, 0), F.lit(" "), unit))
    )


def change_pct(value: Column, prior: Column) -> Column:
    """Change against the prior value's size in percent; null without one or if it is 0."""
    return F.try_divide(value - prior, F.abs(prior)) * 100


def direction(change: Column) -> Column:
    return F.when(change.isNull(), "-").when(change >= 1, "up").when(change <= -1, "down").otherwise("flat")
