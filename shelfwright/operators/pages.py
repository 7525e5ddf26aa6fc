"""Crawled pages: one Arrow pass over the HTML for title, specification rows and lines; the rest natively, without a shuffle.

The pass keeps no tree. An element is a range of the page's text pieces, so the length of any element's text follows from
sums over the pieces before its start and its end, and a page costs time in line with its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import slices

SPARSE, READY, REGION, LABEL, ALONE = 200, 120, 200, 80, 120
#: Characters of the stretches that offsets and pages meet by.
STRETCH = 4_096
#: A short chunk has at most so many characters and blanks; a run of more than RUN of them is cut to its first KEEP.
SHORT, BLANKS, RUN, KEEP = 25, 3, 15, 3
# Elements without product text; kinds of element that a name can mark as furniture, and such names; where a
# page's main content lies, in the order of preference; names of specification sections; marks in a cleaned text.
NOISE = {"script", "style", "nav", "footer", "header", "noscript", "iframe", "aside", "form", "svg", "canvas", "select", "option", "button"}
NAMED = {"div", "ul", "ol", "section", "span"}
FURNITURE = [
    "nav(bar|igation)?", "menu", "footer", "breadcrumb", "cookie", "sidebar", "social", "masthead", "header", "dropdown", "modal", "popup", "tooltip", "newsletter", "subscribe", "country.?select",
    "related", "recommend", "upsell", "cross.?sell", "review", "rating.?stars", "share", "print", "copyright", "legal", "disclaimer", "advert", "banner", "promo", "carousel", "reference", "citation",
    "catlinks", "navbox", "infobox.?hidden", "edit.?section", "mw-jump", "siteSub", "toc",
]
MAIN = [
    "main", "article", '[role="main"]', "#main", "#content", "#mainContent", "#main-content", ".main-content", ".product-detail", ".product-details", ".product-info", ".pdp", ".pdp-content", "#productDetails",
    ".specifications", ".specs", "#specs", ".tech-specs", ".product-specs", "#mw-content-text",
]
SECTIONS = ["spec", "attribute", "parameter", "technical", "character", "rating", "dimension", "property", "detail"]
TABLES, CONTENT, OMITTED = "=== EXTRACTED SPECIFICATION TABLES ===", "=== PAGE CONTENT ===", "[...omitted repetitive list content...]"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN, KEPT_SPACE = {"script", "style", "template"}, {"pre", "textarea"}
_FURNITURE, _SECTION = re.compile("|".join(FURNITURE), re.I), re.compile("|".join(SECTIONS), re.I)
_RANK = {selector: n for n, selector in enumerate(MAIN)}


class _Element:
    __slots__ = ("tag", "drops", "rank", "start", "terms")

    def __init__(self, tag: str, drops: bool, rank: int | None, start: int):
        self.tag, self.drops, self.rank, self.start = tag, drops, rank, start
        self.terms: list[_Term] = []  # terms among its children that have no description yet


class _Table:
    """Lines of a table: a row belongs to the nearest table, a text to the nearest cell."""

    def __init__(self, named: bool):
        self.named, self.caption, self.rows, self.cell, self.in_caption = named, [], [], None, False

    def lines(self) -> Iterator[str]:
        caption = "".join(self.caption)
        if caption or self.named:
            yield f"[{caption or 'Specifications'}]"
        for row in self.rows:
            texts = [t for t in map(" ".join, row) if t]
            if len(texts) == 1 and len(texts[0]) <= ALONE:
                yield texts[0]
            elif len(texts) > 1:
                label, value = texts[0].rstrip(":").strip(), " ".join(texts[1:]).strip()
                if label and value and len(label) <= LABEL:
                    yield f"{label}: {value}"


class _Term:
    def __init__(self):
        self.texts: list[str] = []
        self.value: list[str] = []

    def line(self) -> str | None:
        label, value = " ".join(self.texts).rstrip(":").strip(), " ".join(self.value)
        return f"{label}: {value}" if label and value and len(label) <= LABEL else None


class _Page(HTMLParser):
    """What one page offers; elements that nothing closes end with their parents."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Element] = [_Element("", False, None, 0)]
        self.count: Counter = Counter()
        self.data: list[str] = []
        self.texts: list[str] = []
        self.regions: list[tuple[int, int, int, int]] = []
        self.dropping = 0
        self.title: list[str] | None = None
        self.h1: list[str] | None = None
        self.og: str | None = None
        self.seen: set[str] = set()
        self.tables: list[_Table] = []
        self.within: list[_Table] = []
        self.lists: list[list[_Term]] = []
        self.within_lists: list[list[_Term]] = []
        self.told: list[list[str]] = []  # texts of open terms and descriptions, the innermost last

    def handle_starttag(self, tag, attrs):
        self._text()
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and self.og is None and a.get("property") == "og:title":
            self.og = a.get("content", "")
        if tag in VOID:
            return
        names, ident = a.get("class", "").split(), a.get("id", "")
        drops = tag in NOISE or tag in NAMED and bool(_FURNITURE.search(" ".join(names) + " " + ident))
        ranks = [_RANK[s] for s in (tag, f'[role="{a.get("role", "")}"]', f"#{ident}", *(f".{c}" for c in names)) if s in _RANK] if not drops and not self.dropping else []
        parent, element = self.open[-1], _Element(tag, drops, min(ranks, default=None), len(self.texts))
        self.open.append(element)
        self.count[tag] += 1
        self.dropping += drops
        if tag in ("title", "h1") and getattr(self, tag) is None:
            setattr(self, tag, [])
        if tag == "table":
            self.within.append(_Table(bool(_SECTION.search(" ".join(names) + " " + ident))))
            self.tables.append(self.within[-1])
        elif self.within and tag == "tr":
            self.within[-1].rows.append([])
            self.within[-1].cell = None
        elif self.within and tag in ("td", "th") and self.within[-1].rows:
            self.within[-1].cell = []
            self.within[-1].rows[-1].append(self.within[-1].cell)
        elif self.within and tag == "caption" and not self.within[-1].caption:
            self.within[-1].in_caption = True
        elif tag == "dl":
            self.within_lists.append([])
            self.lists.append(self.within_lists[-1])
        elif tag == "dt":
            term = _Term()
            self.told.append(term.texts)
            if self.within_lists:
                self.within_lists[-1].append(term)
                parent.terms.append(term)
        elif tag == "dd":
            told: list[str] = []
            self.told.append(told)
            for term in parent.terms:
                term.value = told
            parent.terms = []

    def handle_endtag(self, tag):
        self._text()
        if self.count[tag]:
            while self._close() != tag:
                pass

    def _close(self) -> str:
        element = self.open.pop()
        tag = element.tag
        self.count[tag] -= 1
        self.dropping -= element.drops
        if element.rank is not None:
            self.regions.append((element.rank, len(self.regions), element.start, len(self.texts)))
        if tag in ("title", "h1") and not self.count[tag]:
            self.seen.add(tag)
        if tag == "table":
            self.within.pop()
        elif tag == "dl":
            self.within_lists.pop()
        elif tag in ("dt", "dd"):
            self.told.pop()
        elif self.within and tag in ("td", "th"):
            self.within[-1].cell = None
        elif self.within and tag == "caption":
            self.within[-1].in_caption = False
        return tag

    def handle_data(self, data):
        self.data.append(data)

    def handle_comment(self, data):
        self._text()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def close(self):
        super().close()
        self._text()
        while len(self.open) > 1:
            self._close()

    def _text(self) -> None:
        """Takes up the text since the last tag; white space alone counts as one blank or line end."""
        if not self.data:
            return
        text = "".join(self.data)
        self.data = []
        if any(self.count[t] for t in HIDDEN):
            return
        if not text.strip(" \n\t\f\r") and not any(self.count[t] for t in KEPT_SPACE):
            text = "\n" if "\n" in text else " "
        for tag in ("title", "h1"):
            if self.count[tag] and tag not in self.seen:
                getattr(self, tag).append(text)
        bare = text.strip()
        if bare and self.within:
            table = self.within[-1]
            if table.cell is not None:
                table.cell.append(bare)
            elif table.in_caption:
                table.caption.append(bare)
        if bare and self.told:
            self.told[-1].append(bare)
        if not self.dropping:
            self.texts.append(text)

    def name(self) -> str | None:
        return "".join(self.title or []).strip() or (self.og or "").strip() or "".join(self.h1 or []).strip() or None

    def specs(self) -> list[str]:
        terms = [term.line() for listed in self.lists for term in listed]
        return [line for table in self.tables for line in table.lines()] + [line for line in terms if line]

    def lines(self) -> tuple[list[str], bool]:
        """Chunks of the longest main region, if it has REGION characters, else of the page; and whether there is one."""
        length, number = [0], [0]
        for text in self.texts:
            n = len(text.strip())
            length.append(length[-1] + n)
            number.append(number[-1] + (n > 0))
        size = lambda r: length[r[3]] - length[r[2]] + max(0, number[r[3]] - number[r[2]] - 1)
        best = max(self.regions, key=lambda r: (size(r), -r[0], -r[2], r[3]), default=None)
        if best is not None and size(best) < REGION:
            best = None
        texts = self.texts if best is None else self.texts[best[2] : best[3]]
        return [c.strip() for line in "".join(texts).splitlines() for c in line.strip().split("  ") if c.strip()], best is not None


def collapsed(chunks: list[str]) -> list[str]:
    """``collapse_runs`` for one page's chunks, which the pass has at hand."""
    out: list[str] = []
    run: list[str] = []
    for chunk in [*chunks, None]:
        if chunk is not None and len(chunk) <= SHORT and chunk.count(" ") <= BLANKS:
            run.append(chunk)
            continue
        out += run if len(run) <= RUN else [*run[:KEEP], OMITTED]
        run = []
        if chunk is not None:
            out.append(chunk)
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        titles, specs, lines, isolated = [], [], [], []
        for html in batch.column("html"):
            page = _Page()
            page.feed(html.as_py() or "")
            page.close()
            chunks, is_region = page.lines()
            titles.append(page.name())
            specs.append(page.specs())
            lines.append(collapsed(chunks))
            isolated.append(is_region)
        added = [pa.array(titles, pa.string()), pa.array(specs, pa.list_(pa.string())), pa.array(lines, pa.list_(pa.string())), pa.array(isolated, pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *added], ["page_id", "url", "title", "specs", "lines", "isolated"])


def parse_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` -> ``page_id, url, title, specs ARRAY, lines ARRAY, isolated``; null html has neither title nor text.

    Specification rows come from tables and description lists anywhere on the page; nested ones are their own. Lines come
    from what furniture leaves of the longest main region, or of the page if no region has REGION characters.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_parsed, "page_id long, url string, title string, specs array<string>, lines array<string>, isolated boolean")


def is_short(text: Column) -> Column:
    return (F.length(text) <= SHORT) & (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) <= BLANKS)


def collapse_runs(chunks: DataFrame, keys: list[str], pos: str = "pos", text: str = "text") -> DataFrame:
    """Of each run of more than RUN short chunks the first KEEP stay, then a mark: gaps and islands over a document's rows."""
    w = Window.partitionBy(*keys).orderBy(pos)
    runs = chunks.withColumn("is_long", ~is_short(F.col(text))).withColumn("run", F.sum(F.col("is_long").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by_run = Window.partitionBy(*keys, "run", "is_long")
    sized = runs.withColumns({"n": F.count("*").over(by_run), "place": F.row_number().over(by_run.orderBy(pos))})
    kept = sized.where(F.col("is_long") | (F.col("n") <= RUN) | (F.col("place") <= KEEP + 1))
    mark = ~F.col("is_long") & (F.col("n") > RUN) & (F.col("place") == KEEP + 1)
    return kept.withColumn(text, F.when(mark, OMITTED).otherwise(F.col(text))).select(*keys, pos, text)


def clean_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, title, text, n_specs, is_sparse, ready, notes``: specification rows first, then the page's lines. A row stays a row."""
    n = F.size("specs")
    body = F.array_join("lines", "\n")
    text = F.when(n > 0, F.concat(F.lit(TABLES + "\n"), F.array_join("specs", "\n"), F.lit(f"\n\n{CONTENT}\n"), body)).otherwise(body)
    out = parse_pages(pages).withColumns({"text": text, "n_specs": n}).withColumn("is_sparse", F.length("text") < SPARSE)
    notes = F.array_compact(F.array(F.when(F.col("isolated"), "main content region isolated"), F.when(n > 0, F.concat(n.cast("string"), F.lit(" spec-table rows recovered"))), F.when(F.col("is_sparse"), "sparse page")))
    return out.select("page_id", "url", "title", "text", "n_specs", "is_sparse", (~F.col("is_sparse") & (F.length("text") >= READY)).alias("ready"), notes.alias("notes"))


def joined_pages(doc_pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, text`` -> ``doc_id, text``: non-blank pages under '--- [Page n] ---' lines, in order."""
    some = doc_pages.where("trim(text) <> ''").withColumn("block", F.concat(F.lit("--- [Page "), F.col("page_no").cast("string"), F.lit("] ---\n"), F.col("text")))
    return some.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "block"))), lambda x: x["block"]), "\n\n").alias("text"))


def with_offsets(doc_pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, text`` -> the pages that ``joined_pages`` joins, each with ``first`` and ``end``: the characters from
    ``first`` up to ``end`` of the joined text in lower case are the page's block."""
    some = doc_pages.where("trim(text) <> ''").withColumn("head", F.concat(F.lit("--- [Page "), F.col("page_no").cast("string"), F.lit("] ---\n")))
    size = F.length("head") + F.length(F.lower("text"))
    before = F.coalesce(F.sum(size + 2).over(Window.partitionBy("doc_id").orderBy("page_no", "text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return some.withColumn("first", before).select("doc_id", "page_no", "text", "first", (F.col("first") + size).alias("end"))


def evidence_pages(fields: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """``doc_id, field_key, first`` (where the field's evidence starts in the joined text; null if there is none) -> with
    ``page_no``, the page whose block holds that place. No text is looked at again: it is an interval join on numbers,
    by equality of document and of stretches of STRETCH characters, so that a document's fields do not meet all its pages."""
    stretch = F.explode(F.sequence(F.floor(F.col("first") / STRETCH), F.floor((F.col("end") - 1) / STRETCH))).alias("p_stretch")
    pages = with_offsets(doc_pages).select(F.col("doc_id").alias("p_doc"), F.col("page_no").alias("p_page"), F.col("first").alias("p_first"), F.col("end").alias("p_end"), stretch)
    held = F.expr(f"doc_id = p_doc AND floor(first / {STRETCH}) = p_stretch AND first >= p_first AND first < p_end")
    return fields.join(pages, held, "left").select(*fields.columns, F.col("p_page").alias("page_no"))


def snippet_offsets(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_id, field_key, first``: where each field's snippet first stands in its joined text, both in lower case."""
    found = fields.join(texts.select("doc_id", F.lower("text").alias("low")), "doc_id", "left").withColumn("at", F.expr("locate(lower(snippet), low)"))
    return found.select("doc_id", "field_key", F.when((F.col("at") > 0) & (F.col("snippet") != ""), F.col("at") - 1).alias("first"))
