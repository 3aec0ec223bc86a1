"""Evaluation texts leaking into training text (problem 7).

One Aho-Corasick automaton over the normalised questions and answers: each is cut into blocks of
half ``size`` words, and every run of ``size`` words holds a whole block. A text is normalised to
words and scanned once; where a block is met, the words around it are compared with the item's,
and what reaches ``size`` words is a passage. Its places are mapped back to offsets in the
original text.

Distribution: the items are the stated query set. They are normalised by Spark, distinct texts are
counted, and only when they are within ``most_text`` bytes (a node of the automaton for each of
them, some 30 bytes of memory a worker) are they collected and broadcast; more raise an error, so
nothing is left out in silence. Each worker builds the automaton once. Texts of the corpus
are scanned where they lie, once, without a shuffle.

Edge cases: null and blank texts hold nothing; a question or answer of fewer than ``size`` words
is not searched; several items may share a passage and are all reported; repeated rows of an
item report once.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .textform import _PLAIN, TATWEEL, consistent_form, is_invisible, words


@lru_cache(100_000)
def _part(part: str) -> tuple[str, bool]:
    """What a character with its marks becomes, lower-cased, and whether it is white space."""
    form = consistent_form(part)
    return form.lower(), not form and _PLAIN[ord(part[0])].isspace()


@lru_cache(100_000)
def _follows(ch: str) -> bool:
    return bool(unicodedata.combining(ch)) or is_invisible(ch) or ch == TATWEEL or unicodedata.category(ch)[0] == "M"


def word_offsets(text: str) -> list[tuple[str, int, int]]:
    """The words of a text with the start and end of each in the original. Slower than
    ``words``; used only on texts in which something was found."""
    out: list[list] = []
    i, open_word = 0, False
    while i < len(text):
        j = i + 1
        while j < len(text) and _follows(text[j]):
            j += 1
        form, blank = _part(text[i:j])
        if blank:
            open_word = False
        for ch in form:
            if not ch.isalnum():
                open_word = False
            elif open_word:
                out[-1][0] += ch
                out[-1][2] = j
            else:
                out.append([ch, i, j])
                open_word = True
        i = j
    return [tuple(x) for x in out]


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = pa.array([" ".join(words(t)) for t in batch.column("text").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("field"), lines], ["item", "field", "line"])


class Machine:
    """The automaton of blocks of words of distinct lines, and the lines' words."""

    def __init__(self, lines: list[str], size: int):
        import ahocorasick

        self.size, self.lines, block = size, [line.split(" ") for line in lines], (size + 1) // 2
        held: dict[str, list[tuple[int, int]]] = {}
        for n, w in enumerate(self.lines):
            for i in range(0, len(w) - block + 1, block):
                held.setdefault(f" {' '.join(w[i : i + block])} ", []).append((n, i))
        self.automaton = ahocorasick.Automaton()
        for pattern, places in held.items():
            self.automaton.add_word(pattern, (len(pattern), places))
        if held:
            self.automaton.make_automaton()

    def runs(self, w: list[str]) -> dict[int, list[tuple[int, int]]]:
        """For each line met in the words of a text: (first, last) starts of runs of ``size`` words
        that the line holds too, neighbours joined."""
        if len(w) < self.size or not self.lines:
            return {}
        text, at, place = f" {' '.join(w)} ", None, 0
        reach: dict[tuple[int, int], int] = {}  # line and its shift against the text -> where the words last agreed
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            if at is None:  # place of each word in the text -> its number
                at = {}
                for n, x in enumerate(w):
                    at[place] = n
                    place += len(x) + 1
            i = at[end - length + 1]
            for n, j in places:
                if reach.get((n, i - j), -1) > i:
                    continue
                line, a = self.lines[n], 0
                while a < min(i, j) and w[i - a - 1] == line[j - a - 1]:
                    a += 1
                b, most = 0, min(len(w) - i, len(line) - j)
                while b < most and w[i + b] == line[j + b]:
                    b += 1
                reach[n, i - j] = i + b
                if a + b >= self.size:
                    starts.setdefault(n, set()).update(range(i - a, i + b - self.size + 1))
        return {n: _joined(sorted(s)) for n, s in starts.items()}


def _joined(numbers: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for n in numbers:
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [(a, b) for a, b in out]


_MACHINES: dict[str, Machine] = {}


def _found(held: Broadcast, size: int, kind: pa.DataType):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, sources = held.value
        if name not in _MACHINES:  # a worker builds it once and uses it for all its tasks
            _MACHINES.clear()
            _MACHINES[name] = Machine(lines, size)
        machine = _MACHINES[name]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                found = machine.runs(words(text))
                if found:
                    offsets = word_offsets(text)
                    for n, passages in found.items():
                        for first, last in passages:
                            place = last - first + size, offsets[first][1], offsets[last + size - 1][2]
                            rows += [(doc, item, field, *place) for item, field in sources[n]]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (kind, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "item_id", "field", "n_words", "span_start", "span_end"])

    return run


def leaked_passages(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, fields: list[str], size: int = 10, most_text: int = 32 << 20) -> DataFrame:
    """(key, item_id, field, n_words, span_start, span_end): each maximal run of words of an
    item's field found in a text, with its place in the original text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).where("key is not null and text is not null")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), each).select("item", "x.field", "x.text").where("text is not null")
    lines = asked.distinct().mapInArrow(_normalised, "item string, field string, line string").where(F.size(F.split("line", " ")) >= size)
    lines = stage(lines.groupBy("line").agg(F.array_sort(F.collect_set(F.struct("item", "field"))).alias("sources")), "items")
    total = lines.agg(F.sum(F.octet_length("line") + 50 * F.size("sources"))).first()[0] or 0
    if total > most_text:
        raise ValueError(f"the items hold {total} bytes of text; most_text is {most_text}: raise it if the workers' memory holds some 30 bytes for each")
    got = lines.orderBy("line").collect()  # within most_text bytes
    held = spark.sparkContext.broadcast(([r["line"] for r in got], [[(x["item"], x["field"]) for x in r["sources"]] for r in got]))
    return rows.mapInArrow(_found(held, size, pa.int64()), "key long, item_id string, field string, n_words int, span_start long, span_end long")
