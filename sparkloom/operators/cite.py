"""Extractive answers, citations and their verification.

Answers are rows (run_id, answer); hits are rows (run_id, rank, document_name, section_title,
content). The generator is pluggable; the offline one is extractive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

BRACKET, NUMBERED = r"\[SOURCE:\s*([^\]]+)\]", r"【Source (\d+)】"


def extractive_answers(hits: DataFrame, top: int = 3) -> DataFrame:
    """(run_id, answer): from each of the first ``top`` hits the sentence that shares most words
    with the query (the first of equals), followed by its source mark, in rank order. ``hits``
    also need ``query``."""
    spread = hits.where(F.col("rank") <= top).select("run_id", "rank", T.token_set(F.col("query")).alias("q"), F.posexplode(T.sentences(F.col("content"))).alias("position", "sentence"))
    scored = spread.where(F.trim("sentence") != "").withColumn("shared", F.size(F.array_intersect("q", T.token_set(F.col("sentence")))))
    best = scored.groupBy("run_id", "rank").agg(F.max_by("sentence", F.struct("shared", (-F.col("position")).alias("first"))).alias("sentence"))
    marked = F.concat(F.trim("sentence"), F.lit(" 【Source "), F.col("rank").cast("string"), F.lit("】"))
    return best.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", marked.alias("s")))), lambda x: x["s"]), " ").alias("answer"))


def citations(answers: DataFrame, text: str = "answer") -> DataFrame:
    """(run_id, kind, citation), one row per mark: kind ``name`` for [SOURCE: ...] marks, kind
    ``number`` for 【Source N】 marks."""
    named = F.transform(F.regexp_extract_all(F.col(text), F.lit(BRACKET), F.lit(1)), lambda c: F.struct(F.lit("name").alias("kind"), F.trim(c).alias("citation")))
    numbered = F.transform(F.regexp_extract_all(F.col(text), F.lit(NUMBERED), F.lit(1)), lambda c: F.struct(F.lit("number").alias("kind"), c.alias("citation")))
    return answers.select("run_id", F.explode(F.concat(named, numbered)).alias("c")).select("run_id", "c.kind", "c.citation")


def bind(cited: DataFrame, hits: DataFrame) -> DataFrame:
    """``cited`` with ``valid``: a number is that of a hit's rank; a name holds, or is held in,
    the document name, or holds the section title, or is the chunk id of a hit of its run. A blank
    citation is valid for none."""
    keyed = cited.withColumn("low", F.lower(F.trim("citation")))
    sources = hits.select("run_id", F.col("rank").cast("string").alias("r"), F.lower(F.coalesce("document_name", F.lit(""))).alias("d"), F.lower(F.coalesce("section_title", F.lit(""))).alias("s"),
                           F.lower(F.coalesce("chunk_id", F.lit(""))).alias("c") if "chunk_id" in hits.columns else F.lit("").alias("c"))
    names = ((F.col("d") != "") & (F.col("low").contains(F.col("d")) | F.col("d").contains(F.col("low")))) | ((F.col("s") != "") & F.col("low").contains(F.col("s")))
    names = (F.col("low") != "") & (names | (F.col("low") == F.col("c")))
    ok = F.when(F.col("kind") == "number", F.col("r") == F.col("low")).otherwise(names)
    joined = keyed.join(sources, "run_id", "left").groupBy("run_id", "kind", "citation").agg(F.max(F.coalesce(ok, F.lit(False))).alias("valid"))
    return cited.join(joined, ["run_id", "kind", "citation"])


def _marked(text: Column, marks: list[str]) -> Column:
    return T.contains_any(F.lower(text), marks)


def grounding(answers: DataFrame, hits: DataFrame, least: float = 0.15) -> DataFrame:
    """(run_id, position, sentence, best, grounded) for the sentences of more than 20 characters: the
    best token F1 against a hit's content. Sentences that only cite and disclaimers count as
    grounded."""
    spread = answers.select("run_id", F.posexplode(T.sentences(F.col("answer"))).alias("position", "sentence")).withColumn("sentence", F.trim("sentence")).where(F.length("sentence") > 20)
    words = hits.select("run_id", T.blank_set(F.col("content")).alias("w"))
    scored = spread.withColumn("v", T.blank_set(F.col("sentence"))).join(words, "run_id", "left")
    best = scored.groupBy("run_id", "position", "sentence").agg(F.round(F.max(F.coalesce(T.token_f1(F.col("v"), F.col("w")), F.lit(0.0))), 6).alias("best"))
    free = F.col("sentence").rlike(r"^\[SOURCE:.*\]$") | F.col("sentence").rlike(r"^【Source \d+】") | _marked(F.col("sentence"), L.DISCLAIMER_MARKS)
    return best.withColumn("grounded", free | (F.col("best") >= least))


def verify(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """One row an answer: citations (total, valid, hallucinated, malformed), citation accuracy
    (1 without citations), sentences, grounded sentences, faithfulness (1 without sentences)."""
    bound = bind(citations(answers), hits).groupBy("run_id").agg(F.count(F.lit(1)).alias("total_citations"), F.count_if("valid").alias("valid_citations"))
    said = grounding(answers, hits).groupBy("run_id").agg(F.count(F.lit(1)).alias("total_sentences"), F.count_if("grounded").alias("grounded_sentences"))
    bad = F.size(F.regexp_extract_all(F.col("answer"), F.lit(r"((?:\[SOURCE|【Source)[^\]】]*[\]】])"), F.lit(1)))
    rows = answers.select("run_id", bad.alias("marks")).join(bound, "run_id", "left").join(said, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "run_id", zero("total_citations").alias("total_citations"), zero("valid_citations").alias("valid_citations"),
        (zero("total_citations") - zero("valid_citations")).alias("hallucinated_citations"), F.greatest(F.col("marks") - zero("total_citations"), F.lit(0)).alias("malformed_citations"),
        F.round(F.when(zero("total_citations") > 0, F.col("valid_citations") / F.col("total_citations")).otherwise(1.0), 6).alias("citation_accuracy"),
        zero("total_sentences").alias("total_sentences"), zero("grounded_sentences").alias("grounded_sentences"),
        F.round(F.when(zero("total_sentences") > 0, F.col("grounded_sentences") / F.col("total_sentences")).otherwise(1.0), 6).alias("faithfulness"),
    )


def unsupported_claims(answers: DataFrame, hits: DataFrame, least: float = 0.3) -> DataFrame:
    """(run_id, position, claim): uncited sentences of 20 characters or more, disclaimers aside, of
    whose words of four letters or more under ``least`` occur in the run's contents."""
    spread = answers.select("run_id", F.posexplode(T.sentences(F.col("answer"))).alias("position", "sentence")).withColumn("sentence", F.trim("sentence"))
    spread = spread.where((F.length("sentence") >= 20) & ~F.col("sentence").contains("[SOURCE:") & ~F.col("sentence").contains("【Source") & ~_marked(F.col("sentence"), L.CLAIM_DISCLAIMER_MARKS))
    terms = spread.select("run_id", "position", "sentence", T.key_terms(F.col("sentence")).alias("terms")).withColumn("n", F.size("terms"))
    held = hits.select("run_id", F.explode(T.key_terms(F.col("content"))).alias("term")).distinct().withColumn("held", F.lit(1))
    shared = terms.select("run_id", "position", "sentence", "n", F.explode_outer("terms").alias("term")).join(held, ["run_id", "term"], "left")
    shares = shared.groupBy("run_id", "position", "sentence", "n").agg(F.coalesce(F.sum("held"), F.lit(0)).alias("k"))
    return shares.where(F.col("k") / F.greatest(F.col("n"), F.lit(1)) < least).select("run_id", "position", F.substring("sentence", 1, 120).alias("claim"))


def claim_faithfulness(answers: DataFrame, hits: DataFrame, least: float = 0.3) -> DataFrame:
    """(run_id, sentences, unsupported, faithfulness): 1 less the share of unsupported claims in the
    sentences of an answer."""
    bad = unsupported_claims(answers, hits, least).groupBy("run_id").agg(F.count(F.lit(1)).alias("unsupported"))
    rows = answers.select("run_id", F.greatest(F.size(T.sentences(F.col("answer"))), F.lit(1)).alias("sentences")).join(bad, "run_id", "left")
    rows = rows.withColumn("unsupported", F.coalesce("unsupported", F.lit(0)))
    return rows.withColumn("faithfulness", F.round(1.0 - F.col("unsupported") / F.col("sentences"), 6))


def inject_citations(answers: DataFrame, hits: DataFrame, least: int = 2) -> DataFrame:
    """(run_id, answer): each sentence without a [SOURCE: ...] mark gets that of the hit that
    shares most key terms with it (the first of equals), when they share at least ``least``."""
    stop = [*L.MORE_STOP_WORDS, "that", "this", "has", "have"]
    spread = answers.select("run_id", F.posexplode(T.sentences(F.col("answer"))).alias("position", "sentence"))
    keyed = hits.select("run_id", "rank", "document_name", "section_title", "page_number", T.key_terms(F.col("content"), 3, stop).alias("w"))
    pairs = spread.withColumn("v", T.key_terms(F.col("sentence"), 3)).join(keyed, "run_id", "left")
    pairs = pairs.withColumn("shared", F.coalesce(F.size(F.array_intersect("v", "w")), F.lit(0)))
    best = pairs.groupBy("run_id", "position", "sentence").agg(F.max(F.struct("shared", (-F.col("rank")).alias("first"), "document_name", "section_title", "page_number")).alias("b"))
    mark = F.concat(F.lit(" [SOURCE: "), F.coalesce("b.document_name", F.lit("")), F.lit(", "), F.coalesce("b.section_title", F.lit("")), F.lit(", page "), F.coalesce("b.page_number", F.lit("")), F.lit("]"))
    text = F.when(~F.col("sentence").contains("[SOURCE:") & (F.col("b.shared") >= least), F.concat(F.rtrim("sentence"), mark)).otherwise(F.col("sentence"))
    return best.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", text.alias("s")))), lambda x: x["s"]), " ").alias("answer"))


def context(hits: DataFrame, top: int = 5, width: int = 600) -> DataFrame:
    """(run_id, context): numbered evidence blocks in rank order, each cut to ``width``."""
    block = F.concat(F.lit("[EVIDENCE "), F.col("rank").cast("string"), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, width))
    rows = hits.where(F.col("rank") <= top).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("s")))).alias("xs"))
    return rows.select("run_id", F.array_join(F.transform("xs", lambda x: x["s"]), "\n\n").alias("context"))


def with_disclaimer(answer: Column, verdict: Column, disclaimer: str) -> Column:
    """NEEDS_CAUTION answers get the disclaimer, and HIGH confidence in them becomes MEDIUM."""
    return F.when(verdict == "NEEDS_CAUTION", F.concat(F.replace(answer, F.lit("Confidence: HIGH"), F.lit("Confidence: MEDIUM")), F.lit("\n\n" + disclaimer))).otherwise(answer)


def answer_sections(text: Column) -> Column:
    """A formatted answer as struct<answer, evidence array<struct<idx, text>>, confidence,
    disclaimer>: what precedes the first section mark without its heading; the numbered evidence
    in order; MEDIUM where no confidence is stated; a disclaimer of more than 20 characters, else
    empty. Null stays null in every part but the confidence."""
    body = T.strip(F.regexp_replace(text, r"(?s)(?:📚\s*\*\*|\*\*Supporting Evidence\*\*|🎯\s*\*\*|\*\*Confidence\*\*|⚕).*$", ""))
    body = T.strip(F.regexp_replace(body, r"^\s*(?:📋\s*\*{0,2}|\*\*)\s*(?:Answer|الإجابة)\s*\*{0,2}\s*\n?", ""))
    pattern = r"(?s)【Source (\d+)】\s*(.*?)(?=【Source|\n\n|$)"
    numbers, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    evidence = F.zip_with(numbers, parts, lambda n, t: F.struct(n.cast("int").alias("idx"), T.strip(t).alias("text")))
    stated = F.upper(F.regexp_extract(text, r"(?i)(?:🎯|Confidence|الثقة)[^:]*:\s*\*{0,2}\s*(HIGH|MEDIUM|LOW|INSUFFICIENT)", 1))
    note = T.strip(F.regexp_extract(text, r"(?s)⚕\x{FE0F}?\s*(.*?)(?:\n\n|$)", 1))
    return F.struct(
        body.alias("answer"), evidence.alias("evidence"), F.when(F.length(stated) > 0, stated).otherwise("MEDIUM").alias("confidence"),
        F.when(F.length(note) > 20, note).otherwise("").alias("disclaimer"),
    )
