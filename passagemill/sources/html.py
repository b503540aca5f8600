"""Readable text of web pages. [A4 M6]

The page parser runs in tasks over Arrow batches; the filter of chrome lines is a Column expression (functions.text).
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.text import content_lines

# Elements without content, elements that end a line, elements without an end tag, and attribute words.
SKIPPED = set("script style noscript template iframe svg canvas form button select option textarea nav header footer aside".split())
LINE_ENDS = set("p div br hr li ul ol dl dt dd tr td th table h1 h2 h3 h4 h5 h6 section article blockquote pre figure figcaption main address".split())
NO_END = set("br img meta link input hr source area base col embed wbr".split())
NOISE = "nav menu header footer crumb breadcrumb sidebar side-bar share related recommend print banner copyright toolbar top-bar search advert".split()
CONTENT = set("content article editor main text body detail trs zoom".split())


def is_noise(tag: str, attributes: dict[str, str | None]) -> bool:
    """Whether an element is page furniture: by its tag, or by a noise word in an attribute without a content word."""
    marks = [(attributes.get(a) or "").lower() for a in ("class", "id", "role", "aria-label")]
    words = [set("".join(c if c.isascii() and c.isalnum() else " " for c in m).split()) for m in marks]
    return tag in SKIPPED or any(not w & CONTENT and any(n in m for n in NOISE) for m, w in zip(marks, words, strict=True))


class _Text(HTMLParser):
    """Collects the data outside skipped elements; ``depth`` counts open elements inside one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if self.depth:
            self.depth += tag not in NO_END
        elif is_noise(tag, dict(reversed(attrs))):
            self.depth = 1
        else:
            self.end_line(tag)

    def handle_startendtag(self, tag, attrs):
        if not self.depth and not is_noise(tag, dict(reversed(attrs))):
            self.end_line(tag)

    def handle_endtag(self, tag):
        if self.depth:
            self.depth -= 1
        else:
            self.end_line(tag)

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)

    def end_line(self, tag):
        if tag in LINE_ENDS and self.out and self.out[-1][-1:] != "\n":
            self.out.append("\n")


def page_text(html: str | None) -> str:
    """Text of a page with a line for each block element, before the line filter."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "".join(parser.out)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with ``text`` instead of the html column: main text, one line for each block, chrome lines dropped. [A4 B6]"""
    keep = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [page_text(x) for x in b.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    schema = T.StructType([f for f in pages.schema if f.name != html] + [T.StructField("text", T.StringType())])
    return pages.select(*keep, html).mapInArrow(run, schema).withColumn("text", content_lines(F.col("text")))


def register_udtf(spark, name: str = "page_lines") -> None:
    """A SQL table function: page_lines(html) → (line_no, line). [M6]"""
    from pyspark.sql.functions import udtf

    @udtf(returnType="line_no int, line string")
    class PageLines:
        def eval(self, html: str):
            for i, line in enumerate(x.strip() for x in page_text(html).split("\n")):
                if line:
                    yield i, line

    spark.udtf.register(name, PageLines)
