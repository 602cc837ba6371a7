"""Sections of documents: Markdown, reStructuredText, HTML; stemmed search terms."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from marlstone.operators.ordered import TEXTS_AT_ONCE
from marlstone.sources.tables import lines


def _grouped(rows: DataFrame, key: str) -> DataFrame:
    """Lines (key, n, line, title where a section begins) to sections in order."""
    part = F.sum(F.when(F.col("title").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(key).orderBy("n"))
    x = rows.withColumn("section", part).groupBy(key, "section").agg(
        F.coalesce(F.max("title"), F.lit("Introduction")).alias("title"), F.array_sort(F.collect_list(F.when(F.col("title").isNull() & ~F.col("drop"), F.struct("n", "line")))).alias("x")
    )
    body = F.trim(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit(" \t\r\n"))
    return x.select(key, "section", "title", body.alias("body")).where("body <> ''")


def sections_markdown(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sections under headings of one to four marks; what stands before the first is the introduction."""
    x = lines(docs.select(key, F.col(text).alias("text")))
    title = F.regexp_extract("line", r"^#{1,4}\s+(.*?)\s*#*\s*$", 1)
    return _grouped(x.withColumn("title", F.when(title != "", title)).withColumn("drop", F.lit(False)), key)


def sections_rst(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sections under titles with a line of one mark below them, as long as the title less two at least."""
    w = Window.partitionBy(key).orderBy("n")
    x = lines(docs.select(key, F.col(text).alias("text"))).withColumn("below", F.lead("line").over(w))
    rule = r"^([=\-~^\"'*+#])\1{2,}\s*$"
    head = (F.trim("line") != "") & ~F.col("line").rlike(rule) & F.coalesce(F.col("below").rlike(rule) & (F.length(F.trim("below")) >= F.length(F.trim("line")) - 2), F.lit(False))
    x = x.withColumn("title", F.when(head, F.trim("line")))
    return _grouped(x.withColumn("drop", F.col("line").rlike(rule) & F.coalesce(F.lag("title").over(w).isNotNull(), F.lit(False))), key)


class _Sections(HTMLParser):
    """Headings of three levels open sections; outermost blocks of text fill them."""

    # Elements that are left out, that open sections, that hold text, and that have no end.
    QUIET = {"script", "style", "nav", "header", "footer", "aside"}
    HEADS = {"h1", "h2", "h3"}
    BLOCKS = {"p", "li", "pre", "td", "dt", "dd"}
    VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
    # The first of these that a page has is its content: the first main, else the first article, else the first div that plays main.
    SCOPES = ("main", "article", "role")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []  # tag, and the scope that it is the first of
        self.found: dict[str, list[tuple[str, str]]] = {"all": []}
        self.text: list[str] = []

    def _quiet(self) -> bool:
        return any(t in self.QUIET for t, _ in self.open)

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        scope = tag if tag in ("main", "article") else "role" if tag == "div" and ("role", "main") in attrs else ""
        if scope in self.found or self._quiet():
            scope = ""
        if scope:
            self.found[scope] = []
        self.open.append((tag, scope))
        if self._taking(tag):
            self.text = []

    def _taking(self, tag: str) -> bool:
        return not self._quiet() and (tag in self.HEADS or (tag in self.BLOCKS and not any(t in self.BLOCKS for t, _ in self.open[:-1])))

    def handle_endtag(self, tag):
        if all(t != tag for t, _ in self.open):
            return
        while self.open:
            top = self.open[-1][0]
            if self._taking(top):
                raw = "".join(self.text)
                piece = raw.strip() if top == "pre" else " ".join(raw.split())
                for scope in ("all", *(s for _, s in self.open if s)):
                    self.found[scope].append(("head" if top in self.HEADS else "text", piece))
                self.text = []
            self.open.pop()
            if top == tag:
                break

    def close(self):
        super().close()
        while self.open:
            self.handle_endtag(self.open[0][0])

    def handle_data(self, data):
        if not self._quiet():
            self.text.append(data)

    def sections(self) -> list[tuple[str, str]]:
        parts = next((self.found[s] for s in self.SCOPES if s in self.found), self.found["all"])
        out, title, body = [], "Introduction", []
        for kind, piece in [*parts, ("head", "")]:
            if kind == "text":
                body += [piece] if piece else []
                continue
            if "".join(body).strip():
                out.append((title, "\n".join(body).strip()))
            title, body = piece.rstrip("¶ ").strip() or title, []
        return out


def sections_html(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, section, title, body) of whole pages; so many of an Arrow batch are Python's at a time."""
    out = StructType([pages.schema[key], *StructType.fromDDL("section int, title string, body string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(out)
        for part in (batch.slice(i, TEXTS_AT_ONCE) for batch in batches for i in range(0, batch.num_rows, TEXTS_AT_ONCE)):
            rows = []
            for k, raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                p = _Sections()
                p.feed(raw or "")
                p.close()
                rows += [(k, i, t, b) for i, (t, b) in enumerate(p.sections())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], out.names)

    return pages.select(key, html).mapInArrow(run, out)
