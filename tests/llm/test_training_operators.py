import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common, knn, langid, leakage, neardup, packing, queries, spans, tokens
from sparkloom.llm.textform import words


# --- tokens ----------------------------------------------------------------------------

def test_token_budget_counts_every_copy(spark):
    pytest.importorskip("tiktoken")
    rows = [("c", "a b", "s", "en", "d"), ("c", "a b", "s", "en", None), ("c", "a b", "t", None, " "), ("c", None, "s", "en", "d"), ("c", "", None, "en", "d"), ("c", "x" * 60_000, "s", "en", "d")]
    df = spark.createDataFrame(rows, "collection string, text string, source string, language string, domain string").withColumn("_n", F.lit(0))
    got = {(r["level"], r["slice"]): (r["records"], r["tokens"]) for r in tokens.token_budget(df).collect()}
    n, big = tokens.count_tokens("a b"), tokens.count_tokens("x" * 60_000)
    assert got["source", "s"] == (4, 2 * n + big) and got["source", "t"] == (1, n) and got["source", "unknown"] == (1, 0)
    assert got["language", "unknown"] == (1, n) and got["domain", "unknown"] == (2, 2 * n)
    each = tokens.token_counts(df).collect()
    assert len(each) == 6 and sum(r["n_tokens"] for r in each) == 3 * n + big
    assert tokens.token_budget(df.limit(0)).count() == 0


# --- knn -------------------------------------------------------------------------------

def vectors(n, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dim))
    m = centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, dim))
    m[n // 2 : n // 2 + n // 5] = m[0]  # a hot group of copies
    return m.astype(np.float32)


def brute_lists(m, k):
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    return {i: sorted(range(len(m)), key=lambda j: (-s[i, j], j))[:k] for i in range(len(m))}, s


@pytest.mark.parametrize("block", [3000, 150, 40])
def test_knn_recall_and_exact_ties(spark, block):
    m = vectors(900)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = {}
    for r in knn.most_similar(df, k=5, dim=16, block=block).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"], r["cosine"]))
    want, s = brute_lists(m, 5)
    assert set(got) == set(range(900))
    hit = np.mean([len({o for _, o, _ in got[i]} & set(want[i])) / 5 for i in want])
    assert hit >= 0.9
    for i in (0, 450, 500):  # members of the hot group: the smallest ids of the group, itself left out
        assert [o for _, o, _ in sorted(got[i])] == want[i]


def test_knn_small_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert knn.most_similar(spark.createDataFrame([], kind), dim=2).count() == 0
    assert knn.most_similar(spark.createDataFrame([(1, [1.0, 0.0])], kind), dim=2).count() == 0
    two = knn.most_similar(spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], kind), dim=2, k=1)
    assert {(r["id"], r["other"], r["cosine"]) for r in two.collect()} == {(1, 2, 1.0), (2, 1, 1.0), (3, 1, 0.0)}


def test_footrule():
    a = np.array([[3, 1, 2]])
    b = np.array([[3, 2, 9], [7, 8, 9], [1, 3, 5]])
    assert knn.shared_ranks(a, b[None]).tolist() == [[3 + 1, 0, 2 + 2]]
    none, first = np.zeros((1, 3), bool), np.array([[True, False, False]])
    near = lambda least, earlier, posts: knn.footrule_near(a, np.array([least]), knn.places_table(b), earlier, posts)[1].tolist()
    assert near(1, none, 3) == [0, 2] and near(5, none, 3) == [] and near(0, none, 3) == [0, 1, 2]
    assert near(1, first, 1) == [2] and near(1, first, 3) == []


def test_nearest_pivots():
    m = vectors(600, 3)
    u = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    got = knn.nearest_pivots(u, u[:50], 8)
    close = u @ u[:50].T
    for i in range(600):
        assert np.allclose(close[i, got[i]], np.sort(close[i])[::-1][:8]) and len(set(got[i])) == 8
    assert knn.nearest_pivots(u[:0], u[:50], 8).shape == (0, 8)


def test_knn_limits_of_larger_tables(spark, monkeypatch):
    """The footrule limit and the bound of the pivots, as in tables of ``FEW`` vectors and more."""
    monkeypatch.setattr(knn, "FEW", 0)
    m = vectors(900, 5)
    got = {}
    for r in knn.most_similar(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>"), k=5, dim=16, per_root=3).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"]))
    want, _ = brute_lists(m, 5)
    assert all([n for n, _ in sorted(x)] == [1, 2, 3, 4, 5] for x in got.values()) and len(got) == 900
    assert np.mean([len({o for _, o in got[i]} & set(want[i])) / 5 for i in want]) >= 0.9


# --- near duplicates -------------------------------------------------------------------

def edited(rng, w):
    w = list(w)
    for _ in range(max(1, len(w) // 12)):
        i = rng.randrange(len(w))
        rng.choice([lambda: w.__setitem__(i, f"new{rng.randint(0, 9999)}"), lambda: w.pop(i), lambda: w.insert(i, f"ins{rng.randint(0, 9999)}")])()
    return w


def near_rows(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    rows = []
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(70)]
        rows.append(" ".join(base))
        rows += [" ".join(edited(rng, base)) for _ in range(rng.choice([0, 0, 1, 2, 4]))]
    rows += [rows[0]] * 80 + [rows[0].upper(), None, "", "short text", " ".join(["same"] * 40)]
    return [(i, f"n{i:04d}", t) for i, t in enumerate(rows)]


def brute_pairs(rows, size, threshold, least):
    sets = {}
    for _, name, t in rows:
        w = words(t)
        s = set(zip(*(w[i:] for i in range(size))))
        if len(s) >= least:
            sets[name] = s
    names = sorted(sets)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("size, threshold", [(3, 0.5), (5, 0.8)])
def test_near_duplicates_against_brute_force(spark, size, threshold):
    rows = near_rows()
    df = spark.createDataFrame([*rows, rows[0]], "id long, name string, text string").withColumn("digest", F.lit(1)).withColumn("n", F.lit(2))
    members, links = neardup.near_duplicates(df, "id", "name", "text", size, threshold, 10)
    got = {tuple(r) for r in neardup.record_pairs(members, links).collect()}
    want = brute_pairs(rows, size, threshold, 10)
    assert got == want
    groups = {r["name"]: r for r in neardup.record_groups(members, links).collect()}
    assert len(groups) == members.count()
    for a, b in got:
        assert groups[a]["group_id"] == groups[b]["group_id"]


@pytest.mark.parametrize("size, threshold, least_shared, most", [(3, 0.5, 3, 20_000), (3, 0.5, 1, 7), (1, 0.6, 3, 20), (2, 0.8, 9, 20_000)])
def test_no_pair_at_the_threshold_is_lost(spark, size, threshold, least_shared, most):
    """Pairs whose similarity is just the threshold or little above: none may be missing."""
    rng = random.Random(11)
    rows = []
    for g in range(250):
        n = rng.randint(10, 90)
        same = -(-round(100 * threshold) * (2 * n) // round(100 * (1 + threshold)))  # shingles to share
        base = [f"w{g}x{i}" for i in range(n + size - 1)]
        rows += [base, base[: min(n, same) + size - 1] + [f"v{g}x{i}" for i in range(n - min(n, same))]]
    vocabulary = [f"c{i}" for i in range(12)]
    rows += [[rng.choice(vocabulary) for _ in range(rng.randint(12, 30))] for _ in range(150)]  # shingles all share
    rows = [(i, f"n{i:04d}", " ".join(w)) for i, w in enumerate(rows)]
    members, links = neardup.near_duplicates(spark.createDataFrame(rows, "id long, name string, text string"), "id", "name", "text", size, threshold, 10, least_shared, most)
    want = brute_pairs(rows, size, threshold, 10)
    assert len(want) >= 250
    assert {tuple(r) for r in neardup.record_pairs(members, links).collect()} == want


def test_short_records_have_a_group(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "a", long), (2, "b", long), (3, "c", "two words"), (4, "d", "Two, words!"), (5, "d", "Two, words!"), (6, "e", "other"), (7, "f", ""), (8, "g", None), (9, "h", " ... "), (10, "h", " ... ")]
    spark.createDataFrame(rows, "id long, chunk_id string, original_text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = sorted(tuple(r) for r in queries.p3_groups(spark, str(tmp_path)).collect())
    own = [("e", 6), ("f", 7), ("g", 8), ("h", 9)]
    assert got == [("a", 1, 1, 0, 2), ("b", 1, 1, 0, 2), ("c", 3, 3, 0, 2), ("d", 3, 3, 0, 2), *[(n, i, i, 0, 1) for n, i in own]]


def test_near_duplicates_of_nothing(spark):
    members, links = neardup.near_duplicates(spark.createDataFrame([], "id long, name string, text string"), "id", "name", "text")
    assert members.count() == 0 and links.count() == 0 and neardup.record_groups(members, links).count() == 0



def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 70)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["component"] for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 71)}, **{100 + i: 100 for i in range(50)}}


# --- languages -------------------------------------------------------------------------

SAMPLE = {
    "en": ["The children were seen in the waiting area with their parents.", "Families asked for more support during the school year."],
    "fr": ["Les enfants ont été vus dans la salle avec leurs parents.", "Les familles demandent plus de soutien pendant cette année scolaire."],
    "es": ["Los niños fueron atendidos en la sala con sus padres.", "Las familias piden más apoyo durante este curso escolar."],
    "ar": ["يحتاج الأهل إلى فهم خطة الانتقال إلى المدرسة قبل الإحالة.", "أظهرت المتابعة السنوية تحسنا للأطفال في المنزل."],
    "fa": ["بیشتر خانواده‌ها برنامه خواب کودکان را پرسیدند و پاسخ گرفتند.", "گروه پژوهش پرسشنامه کوتاه را برای کودکان توصیه می‌کند."],
}


@pytest.fixture(scope="module")
def weights():
    return langid.train([(k, t) for k, v in SAMPLE.items() for t in v] * 4)


@pytest.mark.parametrize(
    "text, want",
    [
        ("The parents were in the area with children. (CHIME-R, n = 12)", ["en"]), ("Les parents et les enfants dans la salle pendant cette année.", ["fr"]), ("Los padres y los niños en la sala durante este curso.", ["es"]),
        ("يحتاج الأهل إلى خطة المدرسة قبل الإحالة وفق مقياس SOCRA.", ["ar"]), ("خانواده‌ها برنامه کودکان را می‌کند و پاسخ گرفتند.", ["fa"]),
        ("Дети пришли домой после школы.", ["other"]), ("孩子们在学校里学习得很好。", ["other"]), ("Die Kinder wurden gestern mit ihren Eltern in der Schule gesehen und sprachen darüber.", ["other"]),
        ("Les enfants dans la salle avec leurs parents. نعم بالطبع.", ["fr", "ar"]), ("The children were seen in the school. Дети пришли домой.", ["en", "other"]), ("µ-scale of the children during the school year.", ["en"]),
        ("LES ENFANTS ONT ÉTÉ VUS in part DANS LA SALLE AVEC LEURS PARENTS.", ["fr"]), ("Les enfants dans la salle avec leurs parents (n = 3. the children 216). Les familles demandent plus de soutien.", ["fr"]),
        ("The parents were in the area with children. يحتاج الأهل إلى خطة المدرسة قبل الإحالة.", ["en", "ar"]), ("12.4 | 99 ***", []), ("", []), (None, []),
    ],
)
def test_segments(weights, text, want):
    got = langid.segments(text, langid.Scorer(weights))
    assert [x[0] for x in got] == want
    assert all(0 < x[1] <= 1 for x in got)


def test_confidence_follows_held_out_outcomes():
    rng = np.random.default_rng(1)
    duels = np.abs(rng.normal(size=4000)) * 1.5
    for slope in (1, 4):
        right = rng.random(4000) < 1 / (1 + np.exp(-slope * duels))
        assert abs(langid.fitted_slope(duels, right) - slope) <= 1
    assert langid.fitted_slope(duels[:3], right[:3]) == 4


def test_labels_of_other_languages(spark, weights):
    rows = [(1, "Дети пришли домой после школы.", x) for x in ("ru",)] + [(2, "Дети пришли домой после школы.", "en"), (3, "Дети пришли домой после школы.", None)]
    got = {r["id"]: r["languages"] for r in langid.wrong_labels(spark.createDataFrame(rows, "id long, text string, label string"), weights).collect()}
    assert got == {2: ["other"], 3: ["other"]}


def test_wrong_labels(spark, weights):
    en, mix = SAMPLE["en"][0], SAMPLE["en"][0] + " " + SAMPLE["ar"][0]
    rows = [(1, en, "en"), (2, en, " EN-us"), (3, en, "English"), (4, en, None), (5, en, "fr"), (6, mix, "mixed"), (7, mix, "en"), (8, "123", "en"), (9, "123", "n/a"), (10, None, None), (11, "...", "Mixed"), (12, en, "und")]
    got = {r["id"]: r["languages"] for r in langid.wrong_labels(spark.createDataFrame(rows, "id long, text string, label string"), weights).collect()}
    assert got == {4: ["en"], 5: ["en"], 7: ["ar", "en"], 8: ["unknown"], 11: ["unknown"], 12: ["en"]}
    assert langid.language_parts(spark.createDataFrame([], "id long, text string"), weights).count() == 0


def test_held_out_accuracy(spark, data):
    """Rows not among the sample; labels are noisy, so most, not all, must agree."""
    chunks = spark.read.parquet(f"{data}/chunks.parquet").select("id", F.col("original_text").alias("text"), F.col("language").alias("label"))
    w = langid.trained(chunks.where("id % 2 = 0"), per_label=40)
    rest = langid.language_sets(chunks.where("id % 2 = 1"), w).where(F.col("label").isin("ar", "fr", "es", "fa") & (F.col("right") != "unknown"))
    r = rest.agg(F.avg((F.col("label") == F.col("right")).cast("int"))).first()[0]
    assert r > 0.85


# --- packing ---------------------------------------------------------------------------

@pytest.mark.parametrize("grain", [8, None])
def test_packing_places_everything_once(spark, grain):
    rng = random.Random(3)
    sizes = [(i, rng.choice([rng.randint(1, 300), rng.randint(1, 2048), rng.randint(2000, 9000)])) for i in range(1500)] + [(2000 + i, 100) for i in range(700)] + [(3000, 0), (3001, None), (3002, 2048), (3003, 4096)]
    rows = packing.packed(spark.createDataFrame(sizes, "key long, n_tokens long"), 2048, grain).collect()
    fill, placed = Counter(), {}
    for r in rows:
        fill[r["container"]] += r["n_tokens"]
        placed.setdefault(r["key"], []).append((r["token_start"], r["n_tokens"]))
    assert max(fill.values()) <= 2048
    for key, n in sizes:
        parts = sorted(placed[key])
        assert sum(x for _, x in parts) == (n or 0) and len(parts) == max(1, -(-(n or 0) // 2048))
        assert all(a + x == b for (a, x), (b, _) in zip(parts, parts[1:]))
    bound = -(-sum(n or 0 for _, n in sizes) // 2048)
    assert len(fill) <= bound * (1.06 if grain else 1.5) + 5
    assert packing.packed(spark.createDataFrame([], "key long, n_tokens long")).count() == 0


def test_patterns_are_exact():
    counts = {2048: 3, 1024: 5, 1000: 4, 600: 7, 8: 100}
    plan = packing.patterns(counts, 2048)
    held = {}
    for size, first, until, each, container in plan:
        for rank in range(first, until):
            held.setdefault(container + (rank - first) // each, []).append(size)
    assert Counter(x for v in held.values() for x in v) == counts
    assert all(sum(v) <= 2048 for v in held.values())


# --- leakage ---------------------------------------------------------------------------

def test_leakage_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(50)] + ["كتاب", "é"]
    items = [(f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(14)), " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12])))) for k in range(30)] + [("none", None, ""), ("i0b", None, None)]
    items[4] = ("i4", items[3][1], None)  # the same question twice
    docs = []
    for d in range(60):
        text = [rng.choice(vocabulary) for _ in range(30)]
        if d % 3 == 0:
            w = items[d % 30][1].split()
            text[10:10] = w[rng.randint(0, 3) :]
        docs.append((d, " ".join(text).upper().replace("W1", "Ｗ１") if d % 2 else ", ".join(text)))
    docs += [(100, None), (101, ""), (102, items[0][1][:-3])]
    I = spark.createDataFrame([*items, items[0]], "id string, question string, ground_truth_answer string").withColumn("text", F.lit("x"))
    rows = leakage.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), I, "doc_id", "text", "id", ["question", "ground_truth_answer"]).collect()
    want = set()
    for d, t in docs:
        w = words(t)
        runs = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        for i, q, a in items:
            for x in (q, a):
                v = words(x)
                if any(tuple(v[j : j + 10]) in runs for j in range(len(v) - 9)):
                    want.add((d, i))
    assert {(r["key"], r["item_id"]) for r in rows} == want and want
    text = dict(docs)
    for r in rows:
        assert len(words(text[r["key"]][r["span_start"] : r["span_end"]])) == r["n_words"] >= 10


def test_leakage_of_repeated_phrases_and_too_many_items(spark):
    """A line that repeats itself, met at several shifts; runs shorter than asked for are none."""
    line = "a b c d e f g h i j " * 2 + "k"
    kinds = "id string, q string", "doc_id long, text string"
    items = spark.createDataFrame([("x", line), ("short", "a b c")], kinds[0])
    docs = spark.createDataFrame([(1, "z " + "a b c d e f g h i j " * 3), (2, "a b c d e f g h i z"), (3, "j a b c d e f g h i j k")], kinds[1])
    got = {tuple(r) for r in leakage.leaked_passages(docs, items, "doc_id", "text", "id", ["q"]).collect()}
    assert got == {(1, "x", "q", 30, 2, 61), (3, "x", "q", 12, 0, 23)}
    with pytest.raises(ValueError, match="most_text"):
        leakage.leaked_passages(docs, items, "doc_id", "text", "id", ["q"], most_text=5)
    assert leakage.leaked_passages(docs, items.limit(0), "doc_id", "text", "id", ["q"]).count() == 0


def test_word_offsets():
    for t in ["a b", "e‍́a ﬁ ｂ ½x", "́abc d_e", "a​b­c ©d", "  كِتـاب, x", ""]:
        got = leakage.word_offsets(t)
        assert [w for w, _, _ in got] == words(t)
        assert all(0 <= a < b <= len(t) for _, a, b in got)


# --- shared spans ----------------------------------------------------------------------

def brute_spans(rows, n):
    held = {}
    for d, t in rows:
        for p in range(len(t or "") - n + 1):
            held.setdefault(t[p : p + n], set()).add(d)
    out = set()
    for d, t in rows:
        spans_ = []
        for p in range(len(t or "") - n + 1):
            if len(held[t[p : p + n]]) > 1:
                if spans_ and p <= spans_[-1][1]:
                    spans_[-1][1] = p + n
                else:
                    spans_.append([p, p + n])
        out |= {(d, a, b) for a, b in spans_}
    return out


@pytest.mark.parametrize("start", [None, 5, 20])
def test_shared_spans_against_brute_force(spark, start):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcd ي😀") for _ in range(n))
    common_, rows = [text(n) for n in (19, 20, 21, 60)], []
    for d in range(120):
        t = text(rng.choice([0, 5, 30, 80]))
        for _ in range(rng.choice([0, 1, 2])):
            t += rng.choice(common_) + text(rng.choice([0, 3, 15]))
        rows.append((d, t))
    rows += [(200 + i, rows[7][1] + common_[3]) for i in range(40)] + [(300, None), (301, ""), (302, "z" * 100), (303, "z" * 50), (304, "q" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = {(r["doc_id"], r["span_start"], r["span_end"]) for r in spans.shared_spans(df, min_len=20, start=start).collect()}
    assert got == brute_spans(rows, 20)


def test_shared_share_and_empty(spark):
    df = spark.createDataFrame([(1, "a" * 10 + "x" * 30), (2, "y" * 5 + "x" * 30)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_spans"], r["shared_chars"], r["shared_share"]) for r in spans.shared_share(df, min_len=20).collect()}
    assert got == {1: (1, 30, 0.75), 2: (1, 30, round(30 / 35, 6))}
    assert spans.shared_spans(df.limit(0), min_len=20).count() == 0


def test_knn_size_changes_no_rule(spark, monkeypatch):
    """What is compared does not follow the number of vectors: no bound on it changes a row."""
    m = np.random.default_rng(5).normal(size=(700, 32))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    lists = []
    for few in (0, 10**9):
        monkeypatch.setattr(knn, "FEW", few)
        lists.append({tuple(r) for r in knn.most_similar(df, k=5, dim=32).collect()})
    assert lists[0] == lists[1]


def test_pairs_out_of_reach_are_not_made(monkeypatch):
    """Of one list only pairs that can still reach the threshold are made, not all in the ratio of the sizes."""
    import pyarrow as pa

    n = np.arange(60, 120, dtype=np.int64)
    at = n * 3 // 10  # where the shared byte stands in the order of each record
    *keys, shared = np.random.default_rng(3).permutation(2**20)[: n.sum() + 1].astype(np.uint32) << np.uint32(12)
    keys, counts, ends = np.array(keys), np.full(neardup.SLOTS, 100, np.int32), np.cumsum(n)
    for first, k, m in zip(ends - n, at, n):
        counts[neardup._slot(keys[first : first + k])] = 1
        keys[first + k] = shared
        keys[first : first + m].sort()
    counts[neardup._slot(np.array([shared]))] = 50
    posts = list(neardup._posted(0.5, counts, 1, 1, 10**6)(iter([pa.record_batch([pa.array(np.arange(60)), pa.array(n), neardup._binaries(keys, ends)], ["mark", "n", "keys"])])))
    made, repeat = [], np.repeat
    monkeypatch.setattr(neardup.np, "repeat", lambda x, m, *more: made.append(int(np.sum(m))) or repeat(x, m, *more))
    list(neardup._met(0.5, 1)(iter(posts)))
    want = sum(int(n[j] <= 3 * (n[i] - at[i]) - n[i]) for i in range(60) for j in range(i + 1, 60))
    assert made and max(made) == want < 60 * 59 // 2
