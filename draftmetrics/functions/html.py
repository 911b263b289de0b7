"""Extraction from HTML: expressions where a pattern suffices, a parser for sections and label-value pairs."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmetrics.functions.scalars import extract, extract_number
from draftmetrics.functions.text import collapse_blanks, trim_blanks


def strip_tags(html: Column, separator: str = " ") -> Column:
    """Text without tags, and without the bodies of scripts and styles."""
    bare = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->", separator)
    return F.regexp_replace(bare, r"(?s)<[^>]*>", separator)


def page_text(html: Column) -> Column:
    return trim_blanks(collapse_blanks(strip_tags(html)))


def element(html: Column, tag: str, css_class: str | None = None) -> Column:
    """The text of the first ``tag`` (of a class); null if there is none or it is blank."""
    attributes = rf'[^>]*class="(?:[^"]*\s)?{css_class}(?:\s[^"]*)?"[^>]*' if css_class else r"(?:\s[^>]*)?"
    inner = F.regexp_extract(html, rf"(?is)<{tag}{attributes}>(.*?)</{tag}>", 1)
    return F.nullif(trim_blanks(collapse_blanks(F.regexp_replace(inner, r"(?s)<[^>]*>", ""))), F.lit(""))


def first_of(html: Column, *choices: tuple[str, str | None]) -> Column:
    """The first selector that finds text, else the whole page's text."""
    return F.coalesce(*[element(html, tag, css) for tag, css in choices], page_text(html))


def elements(html: Column, tag: str, css_class: str | None = None) -> Column:
    """The texts of all elements of a kind, without blank ones."""
    attributes = rf'[^>]*class="(?:[^"]*\s)?{css_class}(?:\s[^"]*)?"[^>]*' if css_class else r"(?:\s[^>]*)?"
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}{attributes}>(.*?)</{tag}>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: trim_blanks(collapse_blanks(F.regexp_replace(x, r"(?s)<[^>]*>", "")))), lambda x: x != "")


def titled_element(html: Column, tag: str, css_class: str | None = None) -> Column:
    """The ``title`` attribute of the first ``tag`` (of a class), else its text."""
    head = F.regexp_extract(html, rf'(?is)<{tag}\b([^>]*)>' if css_class is None else rf'(?is)<{tag}\b([^>]*class="[^"]*\b{css_class}\b[^"]*"[^>]*)>', 1)
    return F.coalesce(F.nullif(F.regexp_extract(head, r'(?is)(?:^|\s)title="([^"]*)"', 1), F.lit("")), element(html, tag, css_class))


def links(html: Column, target: str = r'[^"]*') -> Column:
    """All link targets that match."""
    return F.regexp_extract_all(html, F.lit(rf'href="({target})"'), F.lit(1))


def total_pages(html: Column) -> Column:
    """Pages of a listing: "/ n 페이지", else the largest page that a script call names, else 1."""
    calls = F.transform(F.regexp_extract_all(html, F.lit(r"fnSearch\((\d+)\)"), F.lit(1)), lambda x: x.cast("long"))
    return F.coalesce(extract_number(html, r"/\s*(\d+)\s*페이지"), F.array_max(calls), F.lit(1).cast("long"))


def call_argument(html: Column, name: str) -> Column:
    """``name: 'value'`` of a script call."""
    return extract(html, rf"{name}:\s*'([^']+)'")


def built_url(base: str, **parts: Column) -> Column:
    """``base?key=value&…`` of the parts that are not null."""
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *[F.concat(F.lit(f"{k}="), v) for k, v in parts.items()]))


class _Text(HTMLParser):
    """Texts of elements in document order: (tag, classes, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, int]] = []  # tag, class, its first piece of text
        self.pieces: list[str] = []
        self.hidden = 0
        self.done: list[tuple[str, str, str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self.open.append((tag, dict(attrs).get("class") or "", len(self.pieces)))
            self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.open):
            while True:
                name, css, first = self.open.pop()
                self.hidden -= name in ("script", "style")
                self.done.append((name, css, " ".join("".join(self.pieces[first:]).split())))
                if name == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.pieces.append(data)


def parse_elements(html: str | None) -> list[tuple[str, str, str]]:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return parser.done


def sections(pages: DataFrame, id_col: str, html_col: str, tags: tuple[str, ...]) -> DataFrame:
    """(id, section, ord, text): the elements named, in the order in which they end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, tag, k, text) for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, (tag, _, text) in enumerate(e for e in parse_elements(html) if e[0] in tags)]
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string()))], names=["id", "section", "ord", "text"])

    return pages.select(F.col(id_col).cast("long"), html_col).mapInArrow(run, "id long, section string, ord long, text string")


def labelled_pairs(pages: DataFrame, id_col: str, html_col: str, label_tag: str, value_tag: str) -> DataFrame:
    """(id, label, value): each label element with the next value element; a label's last occurrence wins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                label, pairs = None, {}
                for tag, _, text in parse_elements(html):
                    if tag == label_tag:
                        label = text
                    elif tag == value_tag and label is not None:
                        pairs[label], label = text, None
                rows += [(i, k, v) for k, v in pairs.items()]
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], names=["id", "label", "value"])

    return pages.select(F.col(id_col).cast("long"), html_col).mapInArrow(run, "id long, label string, value string")
