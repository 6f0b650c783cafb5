"""Filing HTML to typed blocks, tables, pages and page labels.

The walk over the markup is the one step outside the JVM (a page is one row; blocks come back as rows). Page labels,
running headers and page texts are window expressions over the blocks.

Elements are closed as they come: an end tag closes the innermost open element of its name and all within it; a tag
that opens a block closes an open paragraph; stray end tags are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import tables

# Block elements and limits.
BLOCKS = set("html body div p ul ol li h1 h2 h3 h4 h5 h6 section article center blockquote table hr".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = {"script", "style", "head", "title", "noscript"}
HEADING_CHARS, HEADING_BOLD = 250, 0.9
FURNITURE_CHARS, FURNITURE_PAGES, FURNITURE_SHARE = 100, 5, 0.25
KEEP_REPEATED = r"(?i)million|billion|thousand|%|except"
LABEL = r"((?:[A-Z]-)?\d{1,3})"
LABEL_PATTERNS = (rf"(?i)^(?:page\s+)?{LABEL}\.?$", rf"\|\s*{LABEL}$", rf"(?i)^{LABEL}\s+\S.*\b10-K\b", rf"(?i)\b10-K\s*\|?\s*{LABEL}$")
SPACE = re.compile(r"\s+")
BLOCK_ROWS = "pos int, kind string, text string, page int, rows array<array<string>>, header_rows int"


class _Element:
    __slots__ = ("after", "bold", "hidden", "tag")

    def __init__(self, tag: str, bold: bool, hidden: bool, after: bool) -> None:
        self.tag, self.bold, self.hidden, self.after = tag, bold, hidden, after


class _Grid:
    """A table's cells with spans spread: a value stands in the last column of its span, as figures are
    right-aligned; rows below a row span are empty there."""

    def __init__(self) -> None:
        self.rows: list[list[str]] = []
        self.open: dict[int, int] = {}
        self.cell: list[str] | None = None
        self.span = (1, 1)

    def _covered(self) -> None:
        while len(self.rows[-1]) in self.open:
            col = len(self.rows[-1])
            self.rows[-1].append("")
            self.open[col] -= 1
            if not self.open[col]:
                del self.open[col]

    def row(self) -> None:
        self.end_row()
        self.rows.append([])

    def end_row(self) -> None:
        self.end_cell()
        if self.rows:
            self._covered()

    def start_cell(self, colspan: int, rowspan: int) -> None:
        if not self.rows:
            self.rows.append([])
        self.end_cell()
        self._covered()
        self.cell, self.span = [], (colspan, rowspan)

    def end_cell(self) -> None:
        if self.cell is None:
            return
        text = SPACE.sub(" ", "".join(self.cell)).strip()
        start, (colspan, rowspan) = len(self.rows[-1]), self.span
        self.rows[-1] += [""] * (colspan - 1) + [text]
        if rowspan > 1:
            self.open.update({c: rowspan - 1 for c in range(start, start + colspan)})
        self.cell = None


def _span(value: str | None) -> int:
    return max(1, min(int(value), 1000)) if value and value.strip().isdigit() else 1


class _Walk(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [_Element("", False, False, False)]
        self.blocks: list[tuple] = []
        self.runs: list[tuple[str, bool]] = []
        self.page, self.filled = 1, False
        self.grids: list[_Grid] = []
        self.skip = 0

    def emit(self, kind: str, text: str, rows: list[list[str]] | None = None, header_rows: int = 0) -> None:
        self.blocks.append((len(self.blocks), kind, text, self.page, rows, header_rows))
        self.filled = True

    def new_page(self) -> None:
        self.flush()
        if self.filled:  # blank pages aren't counted
            self.page, self.filled = self.page + 1, False

    def flush(self) -> None:
        if self.grids:
            return
        runs, self.runs = self.runs, []
        text = SPACE.sub(" ", "".join(t for t, _ in runs)).strip()
        if not text:
            return
        size = lambda t: len(t) - t.count(" ")
        total = sum(size(t) for t, _ in runs)
        heading = total and sum(size(t) for t, b in runs if b) / total >= HEADING_BOLD and len(text) <= HEADING_CHARS
        self.emit("heading" if heading else "text", text)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if self.skip or top.hidden:
            return
        if self.grids:
            if self.grids[-1].cell is not None:
                self.grids[-1].cell.append(data)
        else:
            self.runs.append((data, top.bold))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.skip += 1
            return
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "").lower()
        if tag in BLOCKS and not self.grids and any(e.tag == "p" for e in self.stack[-3:]) and tag != "hr":
            self._close("p")
        above = self.stack[-1]
        hidden = above.hidden or "display:none" in style
        if "page-break-before:always" in style or "break-before:page" in style:
            self.new_page()
        if tag == "br":
            self.handle_data(" ")
            return
        if self.grids and not hidden:
            self._in_table(tag, a)
        if tag in BLOCKS:
            if self.grids:
                self.handle_data(" ")
            else:
                self.flush()
        after = "page-break-after:always" in style or "break-after:page" in style
        if tag in VOID:
            if after:
                self.new_page()
            return
        weight = re.search(r"font-weight:(\w+)", style)
        bold = True if tag in ("b", "strong") else (weight[1] in ("bold", "bolder") or (weight[1].isdigit() and int(weight[1]) >= 600)) if weight else above.bold
        self.stack.append(_Element(tag, bold, hidden, after))
        if tag == "table" and not hidden:
            self.grids.append(_Grid())

    def _in_table(self, tag: str, a: dict) -> None:
        g = self.grids[-1]
        if tag == "tr":
            g.row()
        elif tag in ("td", "th"):
            g.start_cell(_span(a.get("colspan")), _span(a.get("rowspan")))

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        else:
            self._close(tag)

    def _close(self, tag: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag), None)
        if at is None:
            return
        for e in reversed(self.stack[at:]):
            if e.tag == "table" and not e.hidden and self.grids:
                self._table(self.grids.pop())
            elif e.tag in ("td", "th") and self.grids:
                self.grids[-1].end_cell()
            elif e.tag == "tr" and self.grids:
                self.grids[-1].end_row()
            if e.tag in BLOCKS:
                if self.grids:
                    self.handle_data(" ")
                else:
                    self.flush()
            if e.after:
                self.new_page()
        del self.stack[at:]

    def _table(self, g: _Grid) -> None:
        g.end_row()
        rows = tables.clean(g.rows)
        if self.grids:  # a table in a cell is that cell's text
            if self.grids[-1].cell is not None:
                self.grids[-1].cell.append(" " + " ".join(c for r in rows for c in r if c) + " ")
            return
        self.flush()
        if not rows:
            return
        if tables.is_layout(rows):
            for line in tables.layout_lines(rows):
                self.emit("text", line)
        else:
            n = tables.header_rows(rows)
            self.emit("table", tables.markdown(rows, n), rows, n)

    def done(self) -> list[tuple]:
        self.close()
        while len(self.stack) > 1:
            self._close(self.stack[-1].tag)
        self.flush()
        return self.blocks


def unwrap(html: str) -> str:
    """The body of a submission's text element, if it is wrapped so."""
    if html.lstrip()[:10].upper() == "<DOCUMENT>" and (m := re.search(r"<TEXT>\s*(.*?)\s*(?:</TEXT>|\Z)", html, re.S | re.I)):
        return m[1]
    return html


def parse(html: str | None) -> list[tuple]:
    walk = _Walk()
    walk.feed(unwrap(html or ""))
    return walk.done()


def blocks(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """key and the BLOCK columns of every block, numbered within its document."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *row) for k, h in zip(b[key], b[html], strict=True) for row in parse(h)]
            yield pd.DataFrame(out, columns=[key, "pos", "kind", "text", "page", "rows", "header_rows"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInPandas(each, f"{key} {kind}, {BLOCK_ROWS}")


def furniture_key(kind: Column, text: Column) -> Column:
    """What makes repeated short lines alike: their lower-case text with digits as #; units are kept."""
    return F.when((kind != "table") & (F.length(text) <= FURNITURE_CHARS) & ~text.rlike(KEEP_REPEATED), F.regexp_replace(F.lower(text), r"\d+", "#"))


def running_lines(b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that stand on at least a quarter of a document's pages, and on five."""
    n_pages = b.groupBy(key).agg(F.max("page").alias("n_pages"))
    k = b.select(key, "page", furniture_key(F.col("kind"), F.col("text")).alias("line_key")).where("line_key IS NOT NULL")
    on = k.groupBy(key, "line_key").agg(F.count_distinct("page").alias("pages"))
    return on.join(n_pages, key).where(F.col("pages") >= F.greatest(F.lit(float(FURNITURE_PAGES)), F.col("n_pages") * FURNITURE_SHARE)).select(key, "line_key", "pages")


def label_of(text: Column) -> Column:
    """The printed page number a line shows, upper-case."""
    hits = [F.when(text.rlike(p), F.upper(F.regexp_extract(text, p, 1))) for p in LABEL_PATTERNS]
    return F.when(F.length(text) <= FURNITURE_CHARS, F.coalesce(*hits))


def page_labels(b: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, label and pos of the line it stands on. A page's last three lines are looked at from the end, then its
    first two."""
    page = W.partitionBy(key, "page")
    t = b.where("kind <> 'table'").withColumn("up", F.row_number().over(page.orderBy(F.desc("pos")))).withColumn("down", F.row_number().over(page.orderBy("pos")))
    place = F.when(F.col("up") <= 3, F.col("up")).when(F.col("down") <= 2, 3 + F.col("down"))
    t = t.select(key, "page", "pos", label_of(F.col("text")).alias("label"), place.alias("place")).where("place IS NOT NULL AND label IS NOT NULL")
    return t.groupBy(key, "page").agg(F.min_by(F.struct("label", "pos"), "place").alias("x")).select(key, "page", "x.label", "x.pos")


def validated_labels(raw: DataFrame, key: str = "doc_id") -> DataFrame:
    """Numbers count as labels only if the page before or after has the number before or after; gaps between valid pages
    are filled when both ends agree. Labels with letters count as they are."""
    order = W.partitionBy(key).orderBy("page")
    n = raw.select(key, "page", F.col("label").try_cast("int").alias("n"), "label").where(~F.col("label").rlike("[A-Z]") & F.col("n").isNotNull())
    before = (F.lag("page").over(order) == F.col("page") - 1) & (F.lag("n").over(order) == F.col("n") - 1)
    after = (F.lead("page").over(order) == F.col("page") + 1) & (F.lead("n").over(order) == F.col("n") + 1)
    valid = n.withColumn("ok", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).where("ok")
    gap = F.lead("page").over(order) - F.col("page")
    agrees = (gap > 1) & (F.lead("n").over(order) - F.col("n") == gap)
    upto = F.when(agrees, gap - 1).otherwise(0)
    filled = valid.withColumn("upto", F.coalesce(upto, F.lit(0))).select(key, F.explode(F.sequence(F.lit(0), "upto")).alias("i"), "page", "n")
    numbered = filled.select(key, (F.col("page") + F.col("i")).alias("page"), (F.col("n") + F.col("i")).cast("string").alias("label"))
    return numbered.unionByName(raw.where(F.col("label").rlike("[A-Z]")).select(key, "page", "label"))


def with_furniture(b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks with a flag for running lines and label lines."""
    lines = running_lines(b, key).select(key, "line_key")
    labels = page_labels(b, key).select(key, "pos", F.lit(True).alias("is_label"))
    j = b.withColumn("line_key", furniture_key(F.col("kind"), F.col("text"))).join(lines.withColumn("is_line", F.lit(True)), [key, "line_key"], "left").join(labels, [key, "pos"], "left")
    return j.withColumn("furniture", F.coalesce("is_line", F.lit(False)) | F.coalesce("is_label", F.lit(False))).drop("line_key", "is_line", "is_label")


def pages_of(b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each page's number, label and text without furniture; empty pages stay."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("furniture"), F.struct("pos", "text")))), lambda s: s["text"]), "\n")
    texts = b.groupBy(key, "page").agg(text.alias("text"))
    every = b.groupBy(key).agg(F.max("page").alias("n")).select(key, F.explode(F.sequence(F.lit(1), "n")).alias("page"))
    labels = validated_labels(page_labels(b, key), key)
    return every.join(texts, [key, "page"], "left").join(labels, [key, "page"], "left").select(key, "page", "label", F.coalesce("text", F.lit("")).alias("text"))
