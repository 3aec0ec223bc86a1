"""The best rows of each stated query, scored in Arrow batches where the rows lie.

A task scores its batches against all queries at once and keeps the best k rows of each, so a
task sends k rows a query to the final ranking, never a row a pair. What describes the queries
goes to the tasks with the code; callers hold it to a bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

UNIT = 1e6  # scores are held in millionths
NONE = -(2**62)  # the score of a row that is no answer
KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def units(score: np.ndarray) -> np.ndarray:
    """Scores in millionths, halves up, as the engine rounds to six decimals."""
    return np.floor(np.round(score * UNIT, 4) + 0.5).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.ids = k, np.zeros((queries, 0), np.int64), None

    def _cut(self, scores: np.ndarray, ranks: np.ndarray, n: int) -> np.ndarray:
        key = np.where(scores == NONE, NONE, scores * n + (n - 1 - ranks))
        return np.argpartition(key, scores.shape[1] - self.k, axis=1)[:, -self.k :]

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        scores, ids = scores[:, order], ids[order]
        picked = np.broadcast_to(np.arange(len(ids)), scores.shape)
        if len(ids) > self.k:
            picked = self._cut(scores, picked, len(ids))
        scores, found = np.take_along_axis(scores, picked, 1), ids[picked]
        if self.ids is not None:
            scores, found = np.concatenate((self.scores, scores), axis=1), np.concatenate((self.ids, found), axis=1)
            if scores.shape[1] > self.k:
                names, ranks = np.unique(found, return_inverse=True)
                picked = self._cut(scores, ranks.reshape(found.shape), len(names))
                scores, found = np.take_along_axis(scores, picked, 1), np.take_along_axis(found, picked, 1)
        self.scores, self.ids = scores, found

    def batch(self, queries: list, query_kind: pa.DataType, id_kind: pa.DataType) -> pa.RecordBatch:
        row, col = np.nonzero(self.scores != NONE)
        ids = pa.array(list(self.ids[row, col]), id_kind) if len(row) else pa.array([], id_kind)
        return pa.RecordBatch.from_arrays([pa.array([queries[i] for i in row], query_kind), ids, pa.array(self.scores[row, col] / UNIT, pa.float64())], ["query_id", "id", "score"])


def best_rows(rows: DataFrame, queries: list, query_type: str, k: int, score: Callable[[pa.RecordBatch], np.ndarray], size: int = 1000) -> DataFrame:
    """(query_id, id, score): the k best of each partition of ``rows`` (id, ...) for each of
    ``queries``. ``score`` gives the scores in millionths, queries by rows of a batch."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries), k)
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                ids = part.column("id")
                best.add(score(part), np.array(ids.to_pylist(), object) if id_type == "string" else ids.to_numpy(zero_copy_only=False))
        if best.ids is not None:
            yield best.batch(queries, KINDS[query_type], KINDS[id_type])

    return rows.where("id is not null").mapInArrow(run, f"query_id {query_type}, id {id_type}, score double")


@dataclass
class Terms:
    """Stated queries as rows of 0 and 1 over the terms they use: their own, and with synonyms."""

    ids: list
    kind: str
    vocabulary: list[str]
    own: np.ndarray
    wide: np.ndarray
    phrases: np.ndarray

    def counts(self, terms: pa.Array) -> np.ndarray:
        """How often each row of an array of term lists holds each term of the vocabulary."""
        many = np.nan_to_num(pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        at = pc.index_in(terms.flatten(), value_set=pa.array(self.vocabulary, pa.string())).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(terms)), many)
        known = ~np.isnan(at.astype(float))
        width = max(1, len(self.vocabulary))
        flat = row[known] * width + at[known].astype(np.int64)
        return np.bincount(flat, minlength=len(terms) * width).reshape(len(terms), width)


def stated_terms(queries: DataFrame, phrases: DataFrame | None = None, most_queries: int = 1000, most_terms: int = 20_000) -> Terms | None:
    """The terms of ``queries`` (query_id, text), or None if these are more than may go to every
    task with the code: ``most_queries`` queries or ``most_terms`` different terms, 160 MB of flags
    at the most."""
    rows = queries.select("query_id", F.coalesce(T.token_set(F.col("text")), F.array()).alias("own"), F.coalesce(T.expand_synonyms(F.col("text")), F.array()).alias("wide"))
    got = (rows.join(phrases, "query_id") if phrases is not None else rows.withColumn("phrases", F.lit(0))).limit(most_queries + 1).collect()
    vocabulary = sorted({t for r in got for t in r["wide"]} | {t for r in got for t in r["own"]})
    if len(got) > most_queries or len(vocabulary) > most_terms:
        return None
    at = {t: i for i, t in enumerate(vocabulary)}
    flags = np.zeros((2, len(got), max(1, len(vocabulary))), np.float32)
    for i, r in enumerate(got):
        flags[0, i, [at[t] for t in r["own"]]] = 1
        flags[1, i, [at[t] for t in r["wide"]]] = 1
    return Terms([r["query_id"] for r in got], queries.schema["query_id"].dataType.simpleString(), vocabulary, flags[0], flags[1], np.array([r["phrases"] for r in got], np.int64))


def share(matched: np.ndarray, of: np.ndarray) -> np.ndarray:
    return matched.astype(np.float64) / np.maximum(1, of)[:, None]


def coverage_score(asked: Terms) -> Callable[[pa.RecordBatch], np.ndarray]:
    """The share of a query's terms that a row holds."""

    def score(batch: pa.RecordBatch) -> np.ndarray:
        matched = asked.own @ (asked.counts(batch.column("terms")) > 0).astype(np.float32).T
        return np.where(matched > 0, units(share(matched, asked.own.sum(1))), NONE)

    return score


def profile_score(asked: Terms, weight: float = 0.7, name: float = 0.3, section: float = 0.15, phrase: float = 0.3) -> Callable[[pa.RecordBatch], np.ndarray]:
    """The larger of the coverage of a query's own terms and ``weight`` times that of the terms with
    synonyms, raised by each own term inside the row's name and section and by each shared phrase."""
    known: dict[str, np.ndarray] = {}

    def held(names: pa.Array) -> np.ndarray:
        """How many own terms of each query each name contains."""
        codes = names.dictionary_encode()
        columns = []
        for x in codes.dictionary.to_pylist():
            if x not in known:
                if len(known) > 50_000:
                    known.clear()
                known[x] = asked.own @ np.array([t in x for t in asked.vocabulary] or [False], np.float32)
            columns.append(known[x])
        return np.array(columns).T[:, codes.indices.to_numpy()].astype(np.float64)

    def score(batch: pa.RecordBatch) -> np.ndarray:
        present = (asked.counts(batch.column("terms")) > 0).astype(np.float32).T
        a, b = asked.own @ present, asked.wide @ present
        base = np.maximum(share(a, asked.own.sum(1)), weight * b.astype(np.float64) / np.maximum(1, asked.wide.sum(1))[:, None])
        boost = 1.0 + name * held(batch.column("name")) + section * held(batch.column("section"))
        phrases = np.bitwise_count(asked.phrases[:, None] & batch.column("phrases").to_numpy().astype(np.int64)[None, :])
        return np.where(b > 0, units(base * (boost * (1.0 + phrase * phrases))), NONE)

    return score


def term_weights(asked: Terms, rows: DataFrame) -> tuple[int, float, np.ndarray]:
    """The number of ``rows`` (id, terms), their mean length, and in how many each term of the
    vocabulary occurs: one row a term and task, added up before it reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, length, held = 0, 0, np.zeros(max(1, len(asked.vocabulary)), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                terms = batch.column("terms").slice(i, 1000)
                n, length = n + len(terms), length + len(terms.flatten())
                held += (asked.counts(terms) > 0).sum(0)
        out = np.concatenate(([n, length], held))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(held)), pa.int64()), pa.array(out, pa.int64())], ["term", "n"])

    got = {r["term"]: r["n"] for r in rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = got.get(-2, 0)
    return n, got.get(-1, 0) / n if n else 0.0, np.array([got.get(i, 0) for i in range(max(1, len(asked.vocabulary)))], np.float64)


def bm25_score(asked: Terms, n: int, mean: float, df: np.ndarray, k1: float, b: float) -> Callable[[pa.RecordBatch], np.ndarray]:
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    own = asked.own.astype(np.float64)

    def score(batch: pa.RecordBatch) -> np.ndarray:
        tf = asked.counts(batch.column("terms")).astype(np.float64)
        length = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.float64)
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / (mean or 1.0))[:, None])
        return np.where(own @ (tf > 0).T > 0, units(own @ part.T), NONE)

    return score
