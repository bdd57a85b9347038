"""Links and articles out of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIPPED = {"pre", "code", "script", "style", "aside", "iframe", "button"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def links(pages: DataFrame, html: str, prefix: str, base: str, seen: DataFrame | None = None) -> DataFrame:
    """(url) of anchors whose address starts with prefix, made absolute, each once, without those seen(url)."""
    found = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r"""<a\b[^>]*?\bhref=["'](""" + prefix + r"""[^"']*)["']"""), F.lit(1))).alias("href"))
    out = found.select(F.concat(F.lit(base), F.col("href")).alias("url")).distinct()
    return out.join(seen.select("url"), "url", "left_anti") if seen is not None else out


class _Article(HTMLParser):
    def __init__(self, title: tuple[str, str], body: tuple[str, str]):
        super().__init__(convert_charrefs=True)
        self.want = {"title": title, "body": body}
        self.inside: str | None = None
        self.depth = self.skip = 0
        self.found: dict[str, list[str]] = {}

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        if self.inside is None:
            classes = (dict(attrs).get("class") or "").split()
            for part, (name, cls) in self.want.items():
                if tag == name and part not in self.found and (not cls or cls in classes):
                    self.inside, self.depth, self.found[part] = part, 1, []
                    return
        else:
            self.depth += 1
            self.skip += tag in _SKIPPED

    def handle_endtag(self, tag):
        if self.inside is None or tag in _VOID:
            return
        self.depth -= 1
        self.skip -= tag in _SKIPPED and self.skip > 0
        if self.depth <= 0:
            self.inside, self.skip = None, 0

    def handle_data(self, data):
        if self.inside and not self.skip and data.strip():
            self.found[self.inside].append(data.strip())


def articles(pages: DataFrame, url: str, html: str, title=("h1", "article-content__title"), body=("div", "article-content__body")) -> DataFrame:
    """(doc_id, url, title, content): title and body elements by name and class; pages without either give no row."""

    def run(batches):
        for batch in batches:
            rows = []
            for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parser = _Article(title, body)
                parser.feed(h or "")
                if "title" in parser.found and "body" in parser.found:
                    rows.append({"url": u, "title": " ".join(parser.found["title"]), "content": "\n".join(parser.found["body"])})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("url", pa.string()), ("title", pa.string()), ("content", pa.string())]))

    made = pages.select(F.col(url), F.col(html)).mapInArrow(run, "url string, title string, content string")
    return made.select(F.md5("url").alias("doc_id"), "url", "title", "content")
