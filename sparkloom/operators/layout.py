"""From layout spans and blocks to section-aware chunks.

Spans are rows (doc, page, block_no, line_no, span_no, y0, y1, page_height, font, size, text).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

WHOLE = (Window.unboundedPreceding, 0)


def without_margins(spans: DataFrame, header: float = 0.08, footer: float = 0.08) -> DataFrame:
    """Blocks in the top or bottom margin of the page dropped."""
    return spans.where(~((F.col("y1") < F.col("page_height") * header) | (F.col("y0") > F.col("page_height") * (1 - footer))))


def body_size(spans: DataFrame, pages: int = 10, default: float = 10.0) -> DataFrame:
    """(doc, body): the median size of spans of 20 characters or more on the first pages;
    ``default`` for documents without any."""
    used = F.when((F.col("page") <= pages) & (F.length(F.trim("text")) >= 20), F.col("size"))
    return spans.groupBy("doc").agg(F.coalesce(F.median(used), F.lit(default)).alias("body"))


def is_header(size: Column, font: Column, text: Column, body: Column) -> Column:
    """Larger than the body by a quarter, or bold at body size, or short capitals near it."""
    font = F.lower(F.coalesce(font, F.lit("")))
    bold = font.contains("bold") | font.endswith(".b") | font.endswith("-b")
    n = F.length(text)
    large = (size >= body * 1.25) & size.between(9.0, 30.0)
    strong = bold & (F.abs(size - body) <= 1.0) & (n > 5) & (n < 120)
    capitals = (F.upper(text) == text) & text.rlike(r"\p{Lu}") & (F.abs(size - body) <= 1.5) & (n > 4) & (n < 60)
    return (large | strong | capitals) & (n <= 120)


def carry_sections(rows: DataFrame, by: str, order: list[str], header: Column, title: Column, initial: str = "General Overview") -> DataFrame:
    """``section``: the last header at or before each row."""
    along = Window.partitionBy(by).orderBy(*order).rowsBetween(*WHOLE)
    return rows.withColumn("section", F.coalesce(F.last(F.when(header, title), ignorenulls=True).over(along), F.lit(initial)))


def blocks(spans: DataFrame) -> DataFrame:
    """(doc, page, block_no, text, section) from spans: margins dropped, headers found against
    the document's own body size, sections carried; a block takes the section that holds after
    its last span."""
    kept = without_margins(spans).join(body_size(spans), "doc")
    order = ["page", "block_no", "line_no", "span_no"]
    marked = carry_sections(kept, "doc", order, is_header(F.col("size"), F.col("font"), F.trim("text"), F.col("body")), F.trim("text"))
    out = marked.groupBy("doc", "page", "block_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "span_no", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.max_by("section", F.struct("line_no", "span_no")).alias("section"),
    )
    return out.withColumn("text", T.squeeze(F.col("text"))).where("text != ''")


def count_words(text: str) -> int:
    return len(re.findall(r"\w+", text))


def split_text(text: str, most: int, overlap: int, count: Callable[[str], int]) -> list[str]:
    """Cut at the coarsest separator that helps, merged up to ``most`` with ``overlap`` carried."""
    def parts(t: str, separators: list[str]) -> list[str]:
        if count(t) <= most or not separators:
            return [t]
        if separators[0] not in t:
            return parts(t, separators[1:])
        return [y for x in t.split(separators[0]) if x for y in parts(x, separators[1:])]

    out, held, n = [], [], 0
    for piece in parts(text, ["\n\n", "\n", ". ", " "]):
        size = count(piece)
        if held and n + size > most:
            out.append(" ".join(x for x, _ in held))
            while held and (n > overlap or n + size > most):
                n -= held.pop(0)[1]
        held.append((piece, size))
        n += size
    return [*out, " ".join(x for x, _ in held)] if held else out


def chunks(rows: DataFrame, least: int = 300, most: int = 700, overlap: int = 50, count: Callable[[str], int] = count_words) -> DataFrame:
    """(doc, chunk_no, section, pages, text): section-aware chunks from blocks (doc, page,
    block_no, text, section). Blocks are merged until the token count is within bounds; a new
    section flushes a chunk that is large enough; an oversize block is flushed before it is
    split, so no text is lost; a small chunk that crosses a section takes the later title.
    Documents are laid out whole and in order, and each task folds its rows as they stream by,
    holding one chunk at a time; ``count`` is pluggable and the tokens of joined blocks are the
    sum of theirs."""
    doc_type = rows.schema["doc"].dataType.simpleString()
    schema = f"doc {doc_type}, chunk_no int, section string, pages string, text string"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        doc, number, section, text, pages, n = None, 0, None, [], set(), 0

        def flush():
            nonlocal number, text, pages, n
            whole = " ".join(text).strip()
            if whole:
                out.append((doc, number, section or "Unknown Section", "-".join(sorted(pages)), whole))
                number += 1
            text, pages, n = [], set(), 0

        for frame in frames:
            for d, page, block, new_section in zip(frame["doc"], frame["page"], frame["text"], frame["section"]):
                if d != doc:
                    flush()
                    doc, number, section = d, 0, None
                if section is not None and new_section != section and n >= least:
                    flush()
                section = new_section
                size = count(block)
                if size > most:
                    flush()
                    for part in split_text(block, most, overlap, count):
                        text, pages = [part], {str(page)}
                        flush()
                    continue
                if n + size > most:
                    flush()
                text.append(block)
                pages.add(str(page))
                n += size
                if least <= n <= most:
                    flush()
            if out:
                yield pd.DataFrame(out, columns=["doc", "chunk_no", "section", "pages", "text"])
                out = []
        flush()
        if out:
            yield pd.DataFrame(out, columns=["doc", "chunk_no", "section", "pages", "text"])

    laid = rows.select("doc", "page", "block_no", "text", "section").repartition("doc").sortWithinPartitions("doc", "page", "block_no")
    return laid.mapInPandas(fold, schema)
