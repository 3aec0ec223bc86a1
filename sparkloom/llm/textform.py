"""One consistent form for text that looks the same (problem 5) and its words.

The form, in order: compatibility decomposition (full-width, ligature and presentation
forms become plain), invisible characters, Arabic vowel marks and lengthening strokes removed,
look-alike letters, hyphens and spaces replaced, combining marks put in canonical order,
canonical composition, Arabic letter variants folded, white space collapsed and trimmed.

Two implementations give the same result and are tested against each other:
``consistent_form`` works on one Python string (for use inside Arrow batches of other
operators), ``with_consistent_form`` is the relational operator over a DataFrame.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

# Letters of other scripts drawn like Latin letters, and the Latin letters.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "У": "Y", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "Ѕ": "S", "ѕ": "s", "І": "I",
    "і": "i", "Ј": "J", "ј": "j", "Һ": "H", "һ": "h", "Ӏ": "I", "ӏ": "l", "ԁ": "d", "Ԁ": "D", "ԛ": "q", "Ԛ": "Q",
    "ԝ": "w", "Ԝ": "W", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "α": "a", "ι": "i", "ϲ": "c",
    "Ϲ": "C", "ϳ": "j", "ɡ": "g", "ı": "i", "ɑ": "a",
}
# Hyphens and dashes drawn like the plain hyphen (the minus sign is one of them).
HYPHENS = "‐‑‒–—―−⁃﹘﹣－"
# The ranges of Arabic vowel and annotation marks, and the lengthening stroke.
ARABIC_MARKS = "ً-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭ"
TATWEEL = "ـ"
COMPOSING = "\u0653\u0654\u0655"  # marks that form letters; removed only where they formed none
# Arabic letter variants and digits, and what each is folded to.
ARABIC_FOLDS = {
    "آ": "ا", "أ": "ا", "إ": "ا", "ٱ": "ا", "ٲ": "ا", "ٳ": "ا",
    "ى": "ي", "ی": "ي", "ک": "ك", "گ": "غ",
    **{chr(0x660 + d): str(d) for d in range(10)}, **{chr(0x6F0 + d): str(d) for d in range(10)},
}
# Characters without width that are not of the format category.
OTHER_INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"
FOLD_FROM, FOLD_TO = "".join(ARABIC_FOLDS), "".join(ARABIC_FOLDS.values())

_MARKS = re.compile(f"[{ARABIC_MARKS}{TATWEEL}]+")
_WORD = re.compile(r"[^\W_]+")
_LATIN = re.compile(r"[\x00-\x7f]*")


def is_invisible(ch: str) -> bool:
    """Format characters, variation selectors and fillers; not white space."""
    return unicodedata.category(ch) == "Cf" or ch in OTHER_INVISIBLE or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF


def plain(ch: str) -> str:
    """What a fully decomposed character becomes before marks are ordered."""
    if is_invisible(ch) or ch == TATWEEL or (ch not in COMPOSING and _MARKS.match(ch)):
        return ""
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    if ch in HYPHENS:
        return "-"
    return " " if ch.isspace() else ch


class _Plain(dict):
    def __missing__(self, point: int) -> str:
        ch = chr(point)
        got = "".join(plain(x) for x in unicodedata.normalize("NFKD", ch))
        self[point] = got
        return got


_PLAIN = _Plain()


class _Formed(dict):
    """What a character becomes on its own, composed: composing a text of such parts gives the
    same as composing its decomposed parts, and most texts are then composed already."""

    def __missing__(self, point: int) -> str:
        got = self[point] = unicodedata.normalize("NFC", _PLAIN[point])
        return got


_FORMED = _Formed()


class _Folds(dict):
    def __missing__(self, point: int) -> int:  # held, as a failed lookup costs more than one that succeeds
        self[point] = point
        return point


_FOLDS = _Folds(str.maketrans(ARABIC_FOLDS))


def before_folding(text: str) -> str:
    """The form with Arabic letters and marks as they are: for telling languages apart."""
    if text.isascii():
        return " ".join(text.split())
    return " ".join(unicodedata.normalize("NFC", text.translate(_FORMED)).split(" "))


def consistent_form(text: str | None) -> str | None:
    """The consistent form of one string; null stays null, blank becomes empty."""
    return None if text is None else " ".join(_folded_text(text).split())


def _folded_text(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.translate(_FORMED))
        if any(mark in text for mark in COMPOSING):  # the other marks are gone by now
            text = unicodedata.normalize("NFC", _MARKS.sub("", text))
        text = text.translate(_FOLDS)
    return text


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits in the lower-cased consistent form."""
    return _WORD.findall(_folded_text(text).lower()) if text else []


# --- the relational operator -------------------------------------------------------------

#: Rows of the two tables below: one per code point of Unicode that changes (under 20,000),
#: and one per canonical composition (about 1,000). Bounded by Unicode, so they are broadcast.
_CHANGING = {"Cc", "Cf", "Mn", "Zs", "Zl", "Zp", "Pd", "Lm", "Lo", "Sm", "Po"}  # categories of all characters ``plain`` may change


@cache
def _decompositions() -> list[tuple[str, list[tuple[str, int]]]]:
    out = []
    for point in range(0x110000):
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3:  # Hangul syllables stay whole
            continue
        ch = chr(point)
        if not (unicodedata.decomposition(ch) or unicodedata.combining(ch) or ch in LOOK_ALIKES or unicodedata.category(ch) in _CHANGING):
            continue
        to = _PLAIN[point]
        if to != ch or unicodedata.combining(ch):
            out.append((ch, [(x, unicodedata.combining(x)) for x in to]))
    _PLAIN.clear()
    return out


@cache
def _compositions() -> dict[str, str]:
    out = {}
    for point in range(0x110000):
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3:  # Hangul syllables are composed by arithmetic
            continue
        parts = unicodedata.decomposition(ch := chr(point)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            out["".join(chr(int(x, 16)) for x in parts)] = ch
    return out


@cache
def _untouched() -> str:
    """A Java character class of characters that stay as they are (before the folding that
    ``translate`` does) when no mark or invisible character follows, from the same rule. A class
    of many ranges is slow to match, so only the ranges that hold a character of ``USUAL`` are
    in it; others are pieces of their own, which the mapping leaves as they are."""
    ranges, start = [], None
    for point in range(0x20, 0xA000):
        ch = chr(point)
        ok = not unicodedata.combining(ch) and unicodedata.category(ch)[0] not in "CM" and not 0x1100 <= point <= 0x11FF
        ok = ok and unicodedata.normalize("NFC", "".join(plain(x) for x in unicodedata.normalize("NFKD", ch))) == ch
        if ok and start is None:
            start = point
        if not ok and start is not None:
            ranges.append((start, point - 1))
            start = None
    ranges = [(a, b) for a, b in ranges if any(a <= ord(x) <= b for x in USUAL)]
    return r"\x09-\x0d" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


USUAL = "aé،غبلپ中"
# What may join the character before it: marks, invisible characters, and Hangul letters in their
# conjoining, compatibility and half-width forms.
_FOLLOW = r"\p{M}\p{Cf}\x{0640}\x{034f}\x{115f}-\x{11ff}\x{17b4}\x{17b5}\x{3131}-\x{318e}\x{ffa0}-\x{ffdc}\x{e0100}-\x{e01ef}"


def rebuilt_pieces(pieces: DataFrame) -> DataFrame:
    """(piece, plain) for distinct pieces: each exploded to positioned code points, joined with
    the decomposition and look-alike table, its marks ordered by class behind their starter,
    recomposed and rebuilt."""
    spark = pieces.sparkSession
    mapping = spark.createDataFrame(_decompositions(), "ch string, to array<struct<c:string,ccc:int>>")
    points = pieces.select("piece", F.posexplode(F.split("piece", "")).alias("at", "ch"))
    mapped = points.join(F.broadcast(mapping), "ch", "left").select(
        "piece", "at", F.coalesce("to", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc")))).alias("to")
    )
    spread = mapped.select("piece", "at", F.posexplode_outer("to").alias("sub", "x")).select("piece", "at", "sub", F.col("x.c").alias("c"), F.col("x.ccc").alias("ccc"))
    along = Window.partitionBy("piece").orderBy("at", "sub")
    starters = F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(along)
    ordered = spread.withColumn("starter", starters).groupBy("piece").agg(
        F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("starter", "ccc", "at", "sub", "c")))).alias("xs")
    )
    pairs = F.from_json(F.lit(json.dumps(_compositions())), "map<string,string>")  # folded to a constant
    # Left to right, a mark joins the last starter unless one of its class or higher stands between.
    begin = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("marks"), F.lit(-1).alias("last"))
    text = F.aggregate("xs", begin, lambda acc, x: _composed(acc, x, pairs), lambda acc: F.concat(acc["done"], acc["starter"], acc["marks"]))
    return ordered.select("piece", text.alias("plain"))


def _hangul(starter: Column, c: Column) -> Column:
    """The syllable of a leading letter and a vowel, or of such a syllable and a final letter, by
    Unicode's arithmetic; null for anything else."""
    a, b = F.ascii(starter), F.ascii(c)
    vowel = F.when(a.between(0x1100, 0x1112) & b.between(0x1161, 0x1175), 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28)
    final = F.when(a.between(0xAC00, 0xD7A3) & ((a - 0xAC00) % 28 == 0) & b.between(0x11A8, 0x11C2), a + b - 0x11A7)
    return F.decode(F.unhex(F.hex(F.coalesce(vowel, final))), "UTF-16BE")


def _composed(acc: Column, x: Column, pairs: Column) -> Column:
    free = acc["last"] < x["ccc"]
    both = F.when(F.ascii(x["c"]).between(0x1161, 0x11C2), _hangul(acc["starter"], x["c"])).otherwise(F.try_element_at(pairs, F.concat(acc["starter"], x["c"])))
    joined = F.when(free & (acc["starter"] != ""), both)
    one = F.coalesce(joined, F.when(x["ccc"] == 0, x["c"]), acc["starter"])
    new = joined.isNull() & (x["ccc"] == 0)
    kept = joined.isNull() & (x["ccc"] != 0) & ~x["c"].isin(*COMPOSING)
    return F.struct(
        F.when(new, F.concat(acc["done"], acc["starter"], acc["marks"])).otherwise(acc["done"]).alias("done"),
        one.alias("starter"),
        F.when(new, F.lit("")).when(kept, F.concat(acc["marks"], x["c"])).otherwise(acc["marks"]).alias("marks"),
        F.when(new, F.lit(-1)).when(kept, x["ccc"]).otherwise(acc["last"]).alias("last"),
    )


def _folded(text: Column) -> Column:
    text = F.regexp_replace(text, f"[{ARABIC_MARKS}{TATWEEL}]+", "")
    return F.trim(F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), r"[\x09-\x0d\x1c-\x1f\x20]+", " "))


DICTIONARY = 16 << 20  # bytes of distinct pieces and their forms up to which these are broadcast; above, they are joined by shuffle


def needs_mapping(text: Column) -> Column:
    """Whether a text holds a character that a mapping may change."""
    return text.rlike(f"[^{_untouched()}]")


def mapped_forms(texts: DataFrame) -> DataFrame:
    """(key, form) for rows (key, text), one row a key: every text cut into positioned pieces
    (a character that a mapping touches with its marks, or a run that none touches), the distinct
    pieces mapped, and the strings rebuilt in order."""
    plain_run = f"[{_untouched()}]+(?![{_FOLLOW}])"
    pieces = texts.select("key", F.posexplode(F.expr("regexp_extract_all(text, pattern, 0)".replace("pattern", _sql(f"(?s){plain_run}|.[{_FOLLOW}]*")))).alias("at", "piece"))
    touched = F.col("piece").rlike(f"[^{_untouched()}]")
    known = stage(rebuilt_pieces(pieces.where(touched).select("piece").distinct()), "pieces")
    size = known.agg(F.sum(F.octet_length("piece") + F.octet_length("plain"))).first()[0]
    if (size or 0) <= DICTIONARY:
        known = F.broadcast(known)
    parts = pieces.join(known, "piece", "left").select("key", "at", F.coalesce("plain", "piece").alias("plain"))
    joined = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "plain"))).alias("xs"))
    return joined.select("key", _folded(F.array_join(F.transform("xs", lambda x: x["plain"]), "")).alias("form"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def with_forms(rows: DataFrame, forms: dict[str, str]) -> DataFrame:
    """``rows`` with the consistent form of each text column of ``forms`` in the column named for
    it. Null stays null, blank becomes empty. Rows whose texts need no mapping never leave their
    partition; of the others each distinct text is rebuilt once and joined by its digest (a hot text
    is one row on its side, and adaptive execution splits the rows that join it)."""
    hard = {c: F.coalesce(needs_mapping(F.col(c)), F.lit(False)) for c in forms}
    any_hard = F.lit(False)
    for h in hard.values():
        any_hard = any_hard | h
    light = rows.where(~any_hard).select("*", *[_folded(F.col(c)).alias(f) for c, f in forms.items()])
    texts = [rows.where(h).select(F.col(c).alias("text")) for c, h in hard.items()]
    special = texts[0]
    for more in texts[1:]:
        special = special.unionByName(more)
    rebuilt = mapped_forms(stage(special.select(_digest(F.col("text")).alias("key"), "text").dropDuplicates(["key"]), "special"))
    if len(forms) > 1:
        rebuilt = stage(rebuilt, "forms")
    heavy = rows.where(any_hard)
    for c, f in forms.items():
        known = rebuilt.select(F.col("key").alias("_key"), F.col("form").alias("_form"))
        # A text that needs no mapping keeps its digest as the key, which no rebuilt text has: it goes to any partition.
        heavy = heavy.withColumn("_key", _digest(F.col(c))).join(known, "_key", "left").withColumn(f, F.coalesce("_form", _folded(F.col(c)))).drop("_key", "_form")
    return light.unionByName(heavy.select(light.columns))


def look_alike_pairs(records: DataFrame, name_col: str, text_col: str) -> DataFrame:
    """(name_a, name_b), name_a < name_b: pairs of names whose texts hold a letter, differ, and
    have the same consistent form. Texts are compared by digest; copies of one text are one
    variant, so only different variants of a form are paired. The texts are read once: what needs
    no mapping leaves the scan as two digests."""
    rows = records.select(F.col(name_col).alias("name"), F.col(text_col).alias("text")).where(F.col("name").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keyed = rows.select("name", "text", _digest(F.col("text")).alias("key"), needs_mapping(F.col("text")).alias("hard"))
    scan = stage(keyed.select("name", "key", F.when(~F.col("hard"), _digest(_folded(F.col("text")))).alias("form"), F.when(F.col("hard"), F.col("text")).alias("text")), "scan")
    special = scan.where("form is null").select("key", "text").dropDuplicates(["key"])
    mapped = mapped_forms(special).select("key", _digest(F.col("form")).alias("form"))
    texts = scan.where("form is not null").select("key", "form").distinct().unionByName(mapped)  # one row a text
    several = texts.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form")
    variants = stage(texts.join(several, "form"), "variants")
    pairs = variants.select("form", F.col("key").alias("a")).join(variants.select("form", F.col("key").alias("b")), "form").where("a < b").select("a", "b")
    members = scan.select("key", "name").join(variants.select("key"), "key").distinct()
    both = pairs.join(members.select(F.col("key").alias("a"), F.col("name").alias("n1")), "a").join(members.select(F.col("key").alias("b"), F.col("name").alias("n2")), "b")
    return both.where("n1 != n2").select(F.least("n1", "n2").alias("name_a"), F.greatest("n1", "n2").alias("name_b")).distinct()
