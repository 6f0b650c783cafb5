"""Figures and periods for the sequential parts of claim checking; the same rules as functions.numbers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.functions.numbers import FIGURE, REPORTING_SCALES, SCALES
from tessera.functions.text import CLAIM_STOPWORDS, CLAIM_WORD

FIGURE_RE = re.compile(FIGURE.removeprefix("(?i)"), re.I)
WORD_RE = re.compile(CLAIM_WORD)
STOP = frozenset(CLAIM_STOPWORDS)
AMOUNT = r"\$?\d[\d,]*(?:\.\d+)?\s*(?:%|billion|million)?"
EQUATION = re.compile(rf"((?:{AMOUNT}\s*[+\-−]\s*)+{AMOUNT})\s*=\s*({AMOUNT})", re.I)
STEM = 5


@dataclass(frozen=True)
class Figure:
    value: float
    decimals: int
    scale: float
    percent: bool
    raw: str

    @property
    def amount(self) -> float:
        return self.value * self.scale

    def is_in(self, source: Figure) -> bool:
        """Stated by the source, up to rounding and an unnamed unit."""
        if self.percent != source.percent:
            return self.value == source.value
        want = round(self.value, self.decimals)
        for unit in (source.scale,) if source.scale != 1 else REPORTING_SCALES:
            amount = source.value * unit
            if amount == 0:
                if self.amount == 0:
                    return True
            elif round(amount / self.scale, self.decimals) == want:
                return True
        return False


def figures(text: str) -> list[Figure]:
    out = []
    for m in FIGURE_RE.finditer(text):
        whole, fraction, unit = m[1], m[2] or "", (m[3] or "").strip().lower()
        value = float(whole.replace(",", "") + fraction)
        plain = not fraction and not unit and "," not in whole
        if not (plain and 1990 <= value <= 2035):  # a year
            out.append(Figure(value, max(len(fraction) - 1, 0), SCALES.get(unit, 1.0), unit in ("%", "percent"), m[0].strip()))
    return out


def derived(text: str) -> list[Figure]:
    """Results of sums written out in the text, if they are right."""
    out = []
    for left, right in EQUATION.findall(text):
        terms, result = figures(left), figures(right)
        signs = [1, *(-1 if s in "-−" else 1 for s in re.findall(r"[+\-−]", left))]
        if len(result) == 1 and len(signs) == len(terms):
            total = sum(s * t.amount for s, t in zip(signs, terms, strict=True))
            if round(total / result[0].scale, result[0].decimals) == round(result[0].value, result[0].decimals):
                out.append(result[0])
    return out


def content_words(text: str) -> set[str]:
    return set(WORD_RE.findall(text.lower())) - STOP


def segments(text: str) -> list[str]:
    return [s for s in re.split(r"\n|(?<=[.;])\s+", text) if s.strip()]


def stems(words: set[str]) -> set[str]:
    return {w[:STEM] for w in words if w.isalpha()}
