"""Scope checker, critic and generator: model calls as operators over DataFrames.

A client is a Python function over an Arrow batch that gives a text for each row: a model's raw
answer. It runs on the workers with retries; what comes back is parsed and judged in the JVM, and
what does not parse fails closed. The offline clients are deterministic rules.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.models import with_retry
from . import cite, guard


def rule_scope(blocked: Sequence[str] = L.OFF_TOPIC, caution: Sequence[str] = L.KEYWORD_TERMS) -> Callable[[pd.Series], pd.Series]:
    """REFUSE for blank questions and blocked words, NEEDS_CAUTION for words of caution."""

    def one(text: str | None) -> str:
        low = (text or "").lower()
        level = "REFUSE" if not low.strip() or any(w in low for w in blocked) else "NEEDS_CAUTION" if any(w in low for w in caution) else "ALLOWED"
        return json.dumps({"scope_level": level})

    return lambda texts: texts.map(one)


def overlap_critic(queries: pd.Series, contents: pd.Series) -> pd.Series:
    """Ten times the token F1 of the question and each content, halves up."""

    def words(text: str | None) -> set[str]:
        return set(re.findall(r"\w+", (text or "").lower()))

    def one(query: str | None, texts) -> str:
        q, scores = words(query), []
        for i, t in enumerate(texts):
            c = words(t)
            f1 = 2 * len(q & c) / (len(q) + len(c)) if q and c else 0.0
            scores.append({"chunk_idx": i, "score": int(10 * f1 + 0.5), "reasoning": "shared words"})
        return json.dumps({"scores": scores, "overall_assessment": ""})

    return pd.Series([one(q, t) for q, t in zip(queries, contents)], dtype=object)


def with_scope(rows: DataFrame, text: str, client: Callable[[pd.Series], pd.Series] | None = None, name: str = "scope") -> DataFrame:
    """``rows`` with the scope of the question in column ``text``: ALLOWED, NEEDS_CAUTION or REFUSE."""
    call = with_retry(client or rule_scope())

    @F.pandas_udf("string")
    def asked(texts: pd.Series) -> pd.Series:
        return call(texts)

    return rows.withColumn(name, guard.parsed_scope(asked(F.col(text))))


def evaluate(hits: DataFrame, client: Callable[[pd.Series, pd.Series], pd.Series] = overlap_critic, top: int = 5, width: int = 500) -> DataFrame:
    """(run_id, verdict, mean_relevance, relevant_count): the critic's report on the first ``top``
    contents (cut to ``width``) of each run of ``hits`` (run_id, rank, query, content)."""

    @F.pandas_udf("string")
    def asked(queries: pd.Series, contents: pd.Series) -> pd.Series:
        return with_retry(lambda both: client(*both))((queries, contents))

    content = F.substring(F.coalesce("content", F.lit("")), 1, width)
    runs = hits.where(F.col("rank") <= top).groupBy("run_id").agg(F.min("query").alias("query"), F.array_sort(F.collect_list(F.struct("rank", content.alias("c")))).alias("xs"))
    raw = runs.select("run_id", asked(F.col("query"), F.transform("xs", lambda x: x["c"])).alias("raw"))
    return raw.select("run_id", guard.critic_report(guard.parsed_scores(F.col("raw"))).alias("r")).select("run_id", "r.verdict", "r.mean_relevance", "r.relevant_count")


def generate(hits: DataFrame, client: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """(run_id, answer) for ``hits`` (run_id, rank, query, content). Without a client the answer is
    extractive; a client gets the questions and the assembled contexts."""
    if client is None:
        return cite.extractive_answers(hits)

    @F.pandas_udf("string")
    def asked(queries: pd.Series, contexts: pd.Series) -> pd.Series:
        return with_retry(lambda both: client(*both))((queries, contexts))

    contexts = cite.context(hits).join(hits.groupBy("run_id").agg(F.min("query").alias("query")), "run_id")
    return contexts.select("run_id", asked("query", "context").alias("answer"))


def first_answer(*clients: Callable[..., pd.Series]) -> Callable[..., pd.Series]:
    """Clients in order of preference: a batch is answered by the first that does not fail, and a
    row without an answer by the next; null where none has one."""

    def call(*columns: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(columns[0]), index=columns[0].index, dtype=object)
        for client in clients:
            left = out.isna() | (out == "")
            if not left.any():
                break
            try:
                out[left] = client(*[c[left] for c in columns])
            except Exception:
                continue
        return out

    return call
