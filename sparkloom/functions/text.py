"""Text functions: Column -> Column, evaluated in the JVM unless the name says otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as L

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
WORD = r"[\p{L}\p{N}_]+"


def _class(ranges: Sequence[str]) -> str:
    return "[" + "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in ranges) + "]"


TASHKEEL = _class(L.TASHKEEL)
ARABIC = _class(L.ARABIC_BLOCKS)


def strip(text: Column) -> Column:
    """White space of every kind removed at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def squeeze(text: Column) -> Column:
    """White space runs become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition. Spark has no such function: an Arrow batch goes to Python for
    the rows with a character outside ASCII only."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def normalize_latin(text: Column, compose: bool = False) -> Column:
    """Squeezed, control characters removed. Case is kept."""
    text = nfkc(text) if compose else text
    return F.trim(F.regexp_replace(squeeze(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def strip_latin1(text: Column) -> Column:
    """The older cleaner, which also deletes U+0080 to U+00FF."""
    return F.trim(F.regexp_replace(squeeze(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xff]", ""))


def normalize_arabic(text: Column, compose: bool = False, ta_marbuta: bool = False) -> Column:
    """Lengthening strokes and vowel marks removed; letter variants, digits and punctuation
    folded in one pass; invisible characters become blanks; squeezed."""
    text = nfkc(text) if compose else text
    text = F.regexp_replace(text, r"\x{0640}|" + TASHKEEL, "")
    more = ("ة", "ه") if ta_marbuta else ("", "")
    text = F.translate(text, L.ARABIC_FROM + more[0], L.ARABIC_TO + more[1])
    return squeeze(F.regexp_replace(text, r"[\x{00A0}\x{200B}\x{200C}\x{200D}\x{FEFF}]", " "))


def legacy_arabic(text: Column) -> Column:
    """The older Arabic normalizer: composed, more marks removed, fewer letters and digits folded."""
    text = F.regexp_replace(nfkc(text), r"\x{0640}|" + _class([*L.MORE_TASHKEEL, *L.TASHKEEL]), "")
    return squeeze(F.translate(text, L.LEGACY_FROM, L.LEGACY_TO))


def detect_language(text: Column) -> Column:
    """unknown, ar, mixed or en by the share of Arabic-block characters in the letters. The
    share can exceed 1, as digits and marks of the block count. Null and blank are unknown."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    share = F.regexp_count(text, F.lit(ARABIC)) / letters
    return F.when(text.isNull() | (letters == 0), "unknown").when(share >= 0.40, "ar").when(share <= 0.05, "en").otherwise("mixed")


def normalize(text: Column, compose: bool = False) -> Column:
    """The retrieval field: Arabic rules for ar and mixed texts, Latin rules for the rest."""
    return F.when(detect_language(text).isin("ar", "mixed"), normalize_arabic(text, compose)).otherwise(normalize_latin(text, compose))


def query_prefix(query: Column, language: Column) -> Column:
    """The instruction an embedding model expects before a query."""
    return F.concat(F.when(language == "ar", "searchify: ").otherwise("Represent this sentence for searching relevant passages: "), query)


def tokens(text: Column) -> Column:
    """Words in order: runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def blank_set(text: Column) -> Column:
    """Distinct white-space separated words of the lower-cased text."""
    return F.array_distinct(F.filter(F.split(squeeze(F.lower(text)), " "), lambda x: x != ""))


def key_terms(text: Column, least: int = 4, stop: Sequence[str] = ()) -> Column:
    """Distinct words that are at least ``least`` letters a-z and nothing else."""
    got = F.filter(token_set(text), lambda w: w.rlike(rf"^[a-z]{{{least},}}$"))
    return F.array_except(got, F.array(*map(F.lit, stop))) if stop else got


def sentences(text: Column) -> Column:
    """Split after a full stop, exclamation or question mark that white space follows."""
    return F.split(text, rf"(?<=[.!?]){SPACE}")


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays (sets); 0 when either is empty or they share nothing."""
    shared, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * shared / total).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def expand_acronyms(text: Column, pairs: Sequence[tuple[str, str]] = L.ACRONYMS) -> Column:
    """Case-sensitive replacements, each on the result of the ones before."""
    for short, full in pairs:
        text = F.replace(text, F.lit(short), F.lit(full))
    return text


def expand_synonyms(text: Column, pairs: Sequence[tuple[str, str]] = L.SYNONYMS) -> Column:
    """The token set with the synonyms of every phrase the lower-cased text contains."""
    low = F.lower(text)
    bags = [F.when(low.contains(p), F.array(*map(F.lit, s.split()))).otherwise(F.array().cast("array<string>")) for p, s in pairs]
    return F.array_distinct(F.concat(token_set(text), *bags))


def strip_thinking(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def sanitize_chunk(text: Column) -> Column:
    """Image markup and image-reader errors removed."""
    for pattern in L.IMAGE_MARKS:
        text = F.regexp_replace(text, pattern, "")
    return strip(text)


def sanitize_answer(text: Column) -> Column:
    """Lines with image-reader errors removed; three or more line breaks become two."""
    low = F.lower(text)
    for needed, pattern in L.READER_ERRORS:  # a scan for what is needed alone is linear
        text = F.when(low.contains(needed), F.regexp_replace(text, pattern, "")).otherwise(text)
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def pretty_name(name: Column) -> Column:
    """A document name for display: blanks for underscores, no file ending, split camel case."""
    name = F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"\.(pdf|docx)", "")
    return squeeze(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"))


def score_class(score: Column, high: float = 0.55, medium: float = 0.40) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def authority_badge(name: Column) -> Column:
    """official, peer-reviewed or toolkit, by parts of a document name."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(contains_any(low, L.OFFICIAL), "official").when(contains_any(low, L.PEER_REVIEWED), "peer-reviewed").otherwise("toolkit")


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | text.contains(term)
    return out


def related(a: Column, b: Column) -> Column:
    """Whether one name contains the other, case aside. An empty name is related to nothing."""
    a, b = F.lower(a), F.lower(b)
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))
