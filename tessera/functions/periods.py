"""Which fiscal periods the columns of a release's table stand for."""

from __future__ import annotations

import re

from tessera.operators.entities import MONTHS, YEAR_END_MONTH

Period = tuple[int, int]  # quarter, fiscal year
# Column labels as releases print them.
LABELS = (re.compile(r"Q([1-4])[\s-]*(?:FY\s?)?'?(\d{4}|\d{2})", re.I), re.compile(r"([1-4])Q[\s-]*'?(\d{4}|\d{2})", re.I))
DAY_LABEL = re.compile(r"\d{1,2}-(Mar|Jun|Sep|Dec)-(\d{2})")
QUARTER_OF = {"Mar": 1, "Jun": 2, "Sep": 3, "Dec": 4}
YEAR = re.compile(r"20\d{2}")
THREE_MONTHS = re.compile(r"three months ended|quarter ended", re.I)
DAY = re.compile(rf"({'|'.join(m[:3] for m in MONTHS)})[a-z]*\.?\s+(\d{{1,2}}),?(?:\s+(20\d{{2}}))?", re.I)
FLAT_LABEL = r"(?:Q[1-4]-\d{4}|[1-4]Q-\d{4}|\d{1,2}-[A-Z][a-z]{2}-\d{2})"
FLAT = re.compile(rf"((?:{FLAT_LABEL}\s+)*{FLAT_LABEL})(\s+YoY)?\s*$")
FLAT_VALUE = re.compile(r"\(?-?\$?\d[\d,.]*%?\)?|-")


def label(cell: str) -> Period | None:
    cell = cell.strip()
    for p in LABELS:
        if m := p.fullmatch(cell):
            return int(m[1]), int(m[2]) + (0 if len(m[2]) == 4 else 2000)
    if m := DAY_LABEL.fullmatch(cell):
        return QUARTER_OF[m[1]], 2000 + int(m[2])
    return None


def cells(row: str) -> list[str]:
    return [c.strip() for c in row.strip().strip("|").split("|")]


def fiscal(ticker: str, month: int, day: int, year: int) -> Period:
    """By the company's calendar; an end in a month's first week belongs to the month before."""
    if day <= 7:
        month, year = (12, year - 1) if month == 1 else (month - 1, year)
    end = YEAR_END_MONTH.get(ticker, 12)
    return (month - end - 1) % 12 // 3 + 1, year + (month > end)


def _dates(row: list[str], below: list[str], ticker: str) -> list[Period | None]:
    out: list[Period | None] = []
    for j, cell in enumerate(row):
        m = DAY.fullmatch(cell)
        year = (m[3] or (below[j] if len(below) == len(row) and YEAR.fullmatch(below[j]) else None)) if m else None
        month = next((i for i, name in enumerate(MONTHS, 1) if m and name.startswith(m[1].lower())), 0)
        out.append(fiscal(ticker, month, int(m[2]), int(year)) if year else None)
    return out


def columns(chunk: dict) -> tuple[list[Period | None], bool] | None:
    """The periods of a table's columns, and whether a change column follows; None if they can't be told. Chunks give
    text, ticker, fiscal_year, fiscal_quarter and period_end."""
    lines = chunk["text"].split("\n")
    at_least_two = lambda ls: sum(x is not None for x in ls) >= 2
    if "|---" not in chunk["text"]:
        for line in lines[:4]:
            if (m := FLAT.search(line)) and len(ls := [label(c) for c in m[1].split()]) >= 2 and all(ls):
                return ls, bool(m[2])
        return None
    rows = [cells(x) for x in lines if x.startswith("|") and not x.startswith("|---")][:4]
    named = next((ls for r in rows if at_least_two(ls := [label(c) for c in r])), None)
    if named:
        return named, False
    if not THREE_MONTHS.search(" ".join(c for r in rows for c in r)):
        return None
    for r, below in zip(rows, [*rows[1:], []], strict=True):
        if at_least_two(ls := _dates(r, below, chunk["ticker"])):
            return ls, False
    if chunk["period_end"][:4] == str(chunk["fiscal_year"]):  # else a calendar year isn't the fiscal one
        for r in rows:
            if at_least_two(ls := [(chunk["fiscal_quarter"], int(c)) if YEAR.fullmatch(c) else None for c in r]):
                return ls, False
    return None


def of_figure(row: str, chunk: dict, is_it) -> set[Period] | None:
    """Periods of the cells of a row that hold the figure; None if it can't be said."""
    known = columns(chunk) if chunk["chunk_type"] == "table" else None
    if not known:
        return None
    labels, change = known
    if "|---" in chunk["text"]:
        own = cells(row) if row.startswith("|") else []
        hits = [labels[j] for j, c in enumerate(own) if c and is_it(c)] if len(own) == len(labels) else []
        return set(hits) if hits and all(hits) else None
    found: set[Period] = set()
    run: list[str] = []
    for token in [*row.split(), ""]:
        if token and FLAT_VALUE.fullmatch(token):
            run.append(token)
            continue
        hits = [j for j, t in enumerate(run) if is_it(t)]
        if hits and (len(run) != len(labels) + change or hits[-1] >= len(labels)):
            return None
        found |= {labels[j] for j in hits}
        run = []
    return found or None
