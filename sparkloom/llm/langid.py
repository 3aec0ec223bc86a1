"""Language of each text and of each of its parts (problem 4).

Hierarchical discrimination. A text is cut into sentences. The script of a sentence's letters
predicts its family (Arabic script, Latin script, or another); within a family of several
languages one-versus-one linear support vector machines over words and character n-grams separate
them. A sentence of ``FEW`` words or more of whose character trigrams too few occur in the sample of
the language that won, the fewer the closer the duel, is of none of them: it is ``other``, like a
sentence in another script.

The machines are trained here, on a sample of labelled rows of at most ``per_label`` rows for
each label; labels may be noisy, so training drops what its first round contradicts and is
repeated. The confidence of a sentence is a logistic function of its closest duel; its slope is
fitted to sentences of every fifth sample row, which the machines of that fit have not seen, with a
share of wrong labels fitted beside it. Terms, names and codes inside a sentence do not change
its language.

Distribution: the sample is the only thing that reaches the driver (its bound is a parameter);
the model (4 machines of 2**16 floats and the trigrams of 5 languages, under 3 MB) goes to every
task and every row of the table is scored where it lies. There is no shuffle but the one that
picks the sample.

Edge cases: null, blank and letterless texts are ``unknown`` with confidence 0; a family with no
labelled rows gives its first language; an unsure sentence takes the language of the sentence
before it in the same text (or of most of the text) if of the same family, with its own low
confidence; a sentence of one or two words in another script than the rest is a part of its own, but
not what a full stop inside a number cut off; a sentence in capitals is read like any other;
nulls in the label count as missing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textform import before_folding

FAMILIES = {"arabic": ("ar", "fa"), "latin": ("en", "es", "fr"), "other": ("other",)}
LANGUAGES = ["ar", "en", "es", "fa", "fr"]
PAIRS = [("ar", "fa"), ("en", "es"), ("en", "fr"), ("es", "fr")]
# Names of the languages as labels, after lower-casing and cutting regional tags.
LABELS = {
    "en": "en", "eng": "en", "english": "en", "ar": "ar", "ara": "ar", "arabic": "ar", "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr",
    "es": "es", "spa": "es", "spanish": "es", "castilian": "es", "fa": "fa", "fas": "fa", "per": "fa", "pes": "fa", "persian": "fa", "farsi": "fa",
    "mixed": "mixed", "mul": "mixed", "multiple": "mixed",
}
MISSING = ["", "unknown", "und", "n/a", "na", "none", "null", "nan", "undetermined", "undefined", "unk", "zxx", "-", "--", "?", "??", "tbd", "other", "xx"]
DIMENSIONS, TRIGRAMS = 1 << 16, 1 << 18
# Words from which a sentence can be foreign, the share of known trigrams below which it is, and the share
# below which it is if its closest duel is also under the last value.
FEW, FAMILIAR, DOUBTFUL, CLOSE = 4, 0.6, 0.75, 0.75
SHORT, SURE, QUITE_SURE = 3, 0.75, 0.8  # confidence that a sentence, or one of fewer than ``SHORT`` words, needs to keep its language

_SENTENCE = re.compile(r"(?<=[.!?؟…])[\"'”»)\]]*\s+|[\r\n]+")
_WORDS = re.compile(r"[^\W\d_]+(?:[ً-ٰٟ‌'’][^\W\d_]+)*")
_ARABIC = re.compile(r"[ؠ-يٮ-ۓۺ-ۿݐ-ݿࢠ-ࣿ]")
_FOREIGN = re.compile(r"[^\u0000-\u036f\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\u1e00-\u1eff\u200c\u2019]")


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def _features(word: str) -> list[int]:
    w = f"^{word}$"
    out = [zlib.crc32(b"w" + w.encode("utf-8", "surrogatepass")) % DIMENSIONS]
    out += [zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % DIMENSIONS for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if w[i : i + n] not in ("^", "$")]
    return out


def _trigrams(word: str) -> list[int]:
    w = f"^{word}$"
    return [zlib.crc32(w[i : i + 3].encode("utf-8", "surrogatepass")) % TRIGRAMS for i in range(max(1, len(w) - 2))]


@dataclass
class Model:
    """Weights of the machines, which trigrams each language has, and the slope of the confidence."""

    weights: np.ndarray
    seen: np.ndarray
    slope: float = 4.0


class Scorer:
    """Sentence scores of the machines and shares of known trigrams; those of each word are kept."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.rows = [np.zeros(len(PAIRS) + len(LANGUAGES), np.float32)]

    def word(self, word: str) -> int:
        at = self.known.get(word)
        if at is None:
            if len(self.rows) > 1_000_000:
                self.known.clear()
                del self.rows[1:]
            f = _features(word)
            at = self.known[word] = len(self.rows)
            self.rows.append(np.concatenate((self.model.weights[:, f].sum(1) / len(f) ** 0.5, self.model.seen[:, _trigrams(word)].mean(1))).astype(np.float32))
        return at

    def scores(self, words: list[str]) -> np.ndarray:
        return sum((self.rows[self.word(w)] for w in words), np.zeros(len(self.rows[0]), np.float32)) / max(1, len(words))


def family_words(sentence: str) -> tuple[str | None, list[str]]:
    """The family of a sentence and its words in that family's script, lower-cased, without
    capital codes; no family without letters."""
    found = _WORDS.findall(sentence)
    if not found:
        return None, []
    kinds = {"arabic": [], "latin": [], "other": []}
    for w in found:
        kinds["latin" if w.isascii() else "arabic" if _ARABIC.search(w) else "other" if _FOREIGN.search(w) else "latin"].append(w)
    family = max(kinds, key=lambda k: sum(map(len, kinds[k])))
    if family != "latin":
        return family, kinds[family]
    latin = kinds["latin"]
    plain = [w for w in latin if len(w) == 1 or not w.isupper()]
    codes = 2 * sum(map(len, plain)) >= sum(map(len, latin))  # else the sentence is written in capitals
    return "latin", [w.lower() for w in (plain if codes and plain else latin)]


def closest_duel(family: str, scores: np.ndarray) -> tuple[str, float]:
    """The language with the best worst duel within the family, and that duel."""
    worst = {}
    for lang in FAMILIES[family]:
        duels = [s if lang == a else -s for (a, b), s in zip(PAIRS, scores) if lang in (a, b)]
        worst[lang] = min(duels, default=0.0)
    lang = max(worst, key=lambda x: (worst[x], x))
    return lang, float(worst[lang])


def decide(family: str, words: list[str], scorer: Scorer) -> tuple[str, str, float]:
    """(family, language, confidence) of the words of a sentence."""
    if family == "other":
        return family, "other", 1.0
    scores = scorer.scores(words)
    lang, duel = closest_duel(family, scores)
    familiar = float(scores[len(PAIRS) + LANGUAGES.index(lang)])
    if len(words) >= FEW and (familiar < FAMILIAR or (familiar < DOUBTFUL and duel < CLOSE)):
        return "other", "other", 1.0 - familiar
    return family, lang, float(1 / (1 + np.exp(-scorer.model.slope * min(8.0, duel))))


def whole(sentence: str) -> bool:
    """Whether a stretch of one or two words can be a sentence, not what a full stop in a number or an
    abbreviation cut off: it begins like one and has neither digits nor brackets."""
    s = sentence.strip().lstrip("¿¡\"'«“ ")
    return bool(s) and s[0].isalpha() and not s[0].islower() and not any(c.isdigit() or c in "()[]" for c in s)


def segments(text: str | None, scorer: Scorer) -> list[tuple[str, float, int]]:
    """(language, confidence, letters) of the parts of a text: neighbouring sentences of one
    language are one part."""
    found = []
    for s in sentences(before_folding_lines(text or "")):
        family, words = family_words(s)
        if family:
            family, lang, p = decide(family, words, scorer)
            counts = len(words) >= SHORT or whole(s)
            found.append([family, lang, p, counts and p >= (SURE if len(words) >= SHORT else QUITE_SURE), sum(map(len, words)), counts])
    if any(x[5] for x in found):  # what was cut off in another script is a term, not a sentence
        families = {x[0] for x in found if x[5]}
        found = [x for x in found if x[0] in families]
    # Unsure sentences follow the language of surer ones of their family.
    weight = {}
    for _, lang, _, sure, letters, _ in found:
        if sure:
            weight[lang] = weight.get(lang, 0) + letters
    lead = {f: max((x for x in langs if x in weight), key=lambda x: weight[x], default=None) for f, langs in FAMILIES.items()}
    for i, (family, _, p, sure, _, _) in enumerate(found):
        if not sure and lead[family]:
            found[i][1] = next((x[1] for x in reversed(found[:i]) if x[0] == family and x[3]), lead[family])
            found[i][2] = min(p, SURE)
    out = []
    for _, lang, p, _, letters, _ in found:
        if out and out[-1][0] == lang:
            w = out[-1][2] + letters
            out[-1] = (lang, (out[-1][1] * out[-1][2] + p * letters) / max(1, w), w)
        else:
            out.append((lang, p, letters))
    return out


def before_folding_lines(text: str) -> str:
    """The form before Arabic folding, with line breaks kept as sentence ends."""
    if text.isascii():
        return text
    return "\n".join(before_folding(line) for line in text.splitlines())


def _sample_rows(samples: list[tuple[str, str]]) -> list[list[tuple[str, list[str], np.ndarray, np.ndarray]]]:
    """For each text (label, words, feature places, feature values) of its sentences of three words or more."""
    out, known = [], {}
    for label, text in samples:
        rows = []
        out.append(rows)
        for s in sentences(before_folding_lines(text)):
            family, words = family_words(s)
            if family and len(words) >= 3 and label in FAMILIES[family]:
                for w in words:
                    if w not in known:
                        known[w] = np.array(_features(w))
                f = [known[w] for w in words]
                values = np.concatenate([np.full(len(x), len(x) ** -0.5 / len(f), np.float32) for x in f])
                at, back = np.unique(np.concatenate(f), return_inverse=True)
                rows.append((label, words, at, np.bincount(back, values).astype(np.float32)))
    return out


def _duels(weights: np.ndarray, label: str, at: np.ndarray, x: np.ndarray) -> list[float]:
    return [float(weights[m][at] @ x) * (1 if label == a else -1) for m, (a, b) in enumerate(PAIRS) if label in (a, b)]


def _machines(rows: list, epochs: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (machines x dimensions) by averaged hinge-loss descent, and the rows kept. The rows
    are in a fixed order, so the result is the same each time."""
    keep = np.ones(len(rows), bool)
    weights = np.zeros((len(PAIRS), DIMENSIONS), np.float32)
    for turn in range(rounds):
        rng = np.random.default_rng(7)
        for m, (a, b) in enumerate(PAIRS):
            mine = [i for i, (label, *_) in enumerate(rows) if keep[i] and label in (a, b)]
            w, total, rate = np.zeros(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32), 4.0
            for _ in range(epochs):
                for i in rng.permutation(mine) if mine else []:
                    label, _, at, x = rows[i]
                    y = 1.0 if label == a else -1.0
                    if y * float(w[at] @ x) < 1:
                        w[at] += rate * y * x
                total += w
                rate *= 0.7
            weights[m] = total / epochs
        if turn + 1 < rounds:
            keep = np.array([min(_duels(weights, label, at, x)) > 0 for label, _, at, x in rows], bool)
    return weights, keep


def fitted_slope(duels: np.ndarray, right: np.ndarray) -> float:
    """The slope of the logistic confidence that makes held-out outcomes likeliest, when a share of
    the labels, fitted beside it, is wrong; 4 without any."""
    best = (-np.inf, 4.0)
    for slope in (0.5, 1, 1.5, 2, 3, 4, 6, 8, 12, 16) if len(duels) >= 20 else ():
        p = 1 / (1 + np.exp(-slope * np.minimum(8.0, duels)))
        for wrong in (0.001, 0.01, 0.02, 0.05, 0.1, 0.2):
            q = p * (1 - wrong) + (1 - p) * wrong
            best = max(best, (float(np.log(np.where(right, q, 1 - q)).sum()), float(slope)))
    return best[1]


def train(samples: list[tuple[str, str]], epochs: int = 6, rounds: int = 2) -> Model:
    """A model from (label, text) rows."""
    texts = _sample_rows(samples)
    held = [r for x in texts[4::5] for r in x]
    first, _ = _machines([r for i, x in enumerate(texts) if i % 5 != 4 for r in x], max(1, epochs // 2), 1)
    duels, right = [], []
    for label, _, at, x in held:
        family = next(f for f, langs in FAMILIES.items() if label in langs)
        lang, duel = closest_duel(family, [float(w[at] @ x) for w in first])
        duels.append(duel), right.append(lang == label)
    rows = [r for x in texts for r in x]
    weights, keep = _machines(rows, epochs, rounds)
    seen = np.zeros((len(LANGUAGES), TRIGRAMS), bool)
    for i, lang in enumerate(LANGUAGES):
        for word in {w for (label, words, _, _), ok in zip(rows, keep) if ok and label == lang for w in words}:
            seen[i, _trigrams(word)] = True
    return Model(weights, seen, fitted_slope(np.array(duels), np.array(right, bool)))


def label_of(label: Column) -> Column:
    """A given label as one of the languages, mixed, null when missing, or itself when foreign."""
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"[\s\p{Z}]+", " ")))
    head = F.split(low, "[-_ ]").getItem(0)
    names = F.coalesce(*[F.when(head.isin([k for k, v in LABELS.items() if v == lang]), lang) for lang in sorted(set(LABELS.values()))])
    return F.when(low.isin(MISSING), F.lit(None)).otherwise(F.coalesce(names, head))


def trained(rows: DataFrame, per_label: int = 400) -> Model:
    """A model from rows (id, text, label): at most ``per_label`` rows of each language, those
    with the smallest hash of their id, go to the driver."""
    known = rows.select("id", "text", label_of(F.col("label")).alias("label")).where(F.col("label").isin(LANGUAGES) & F.col("text").isNotNull())
    some = Window.partitionBy("label").orderBy("h", "id")
    ids = known.select("id", "label", F.xxhash64("id").alias("h")).withColumn("n", F.row_number().over(some)).where(F.col("n") <= per_label).select("id")
    got = known.join(F.broadcast(ids), "id").toPandas()  # 5 * per_label rows
    got = got.sort_values(["label", "id", "text"])
    return train(list(zip(got["label"], got["text"])))


def language_parts(rows: DataFrame, model: Model) -> DataFrame:
    """(id, part, language, confidence, letters, parts): one row per part of each text of rows
    (id, text); a text without letters is one part ``unknown``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                got = segments(text, scorer) or [("unknown", 0.0, 0)]
                out += [(key, i, lang, round(p, 6), n, len(got)) for i, (lang, p, n) in enumerate(got)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int32()))],
                ["id", "part", "language", "confidence", "letters", "parts"],
            ) if out else pa.RecordBatch.from_pylist([], pa.schema([("id", pa.int64()), ("part", pa.int32()), ("language", pa.string()), ("confidence", pa.float64()), ("letters", pa.int64()), ("parts", pa.int32())]))

    return rows.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, part int, language string, confidence double, letters long, parts int")


def language_sets(rows: DataFrame, model: Model) -> DataFrame:
    """(id, label, right, languages, confidence) for rows (id, text, label): the right label,
    the languages in which sentences are written, and the confidence over the letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            langs, rights, sure = [], [], []
            for text in batch.column("text").to_pylist():
                got = segments(text, scorer)
                names = sorted({x[0] for x in got}) or ["unknown"]
                langs.append(names), rights.append(names[0] if len(names) == 1 else "mixed")
                total = sum(x[2] for x in got)
                sure.append(round(sum(x[1] * x[2] for x in got) / total, 6) if total else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(rights, pa.string()), pa.array(langs, pa.list_(pa.string())), pa.array(sure, pa.float64())],
                ["id", "label", "right", "languages", "confidence"],
            )

    return rows.select(F.col("id").cast("long").alias("id"), "text", F.col("label").cast("string").alias("label")).mapInArrow(run, "id long, label string, right string, languages array<string>, confidence double")


def wrong_labels(rows: DataFrame, model: Model) -> DataFrame:
    """(id, label, right, languages, confidence) of the rows whose label is missing or wrong:
    with letters, anything but the right label; without, only a language or mixed. A text in none
    of the languages may bear the label of any language but these."""
    given = label_of(F.col("label"))
    wrong = F.when(F.col("right") == "other", given.isin(*LANGUAGES, "mixed")).otherwise(given != F.col("right"))
    return language_sets(rows, model).where(F.when(F.col("right") == "unknown", given.isNotNull()).otherwise(given.isNull() | wrong))
