"""Most similar vectors for every vector (problem 2): a permutation index.

A bounded sample of the vectors serves as pivots. Every vector is represented by its ``prefix``
nearest pivots in order and posted in the inverted files of the first ``posts`` of them. Within a
file the entries are ranked by the footrule distance of their pivot orders to that of the vector
asked for (a pivot missing from a prefix counts as place ``prefix``); those nearer than a limit are
reranked by cosine, and the best k over all files are kept. The limit is the footrule distance of
the ``depth``-th best of the pivots nearest to the vector: as pivots are a sample of the vectors, about
``depth`` vectors a pivot are within it. By default ``depth`` is ``prefix`` and nothing in a file is beyond
it, whatever the number of vectors: a smaller limit lost cases.
A pair is ranked in the first file that both are in, and
leaves it only if its cosine reaches that of the k-th best pivot within the limit, which is a vector too.

Distribution: identical vectors are collapsed first. Pivots are drawn from the distinct vectors,
so dense regions hold more of them and files stay even; their number grows with the square root of
that of the vectors (times ``per_root``), and with it the candidates of a vector, up to
``MAX_PIVOTS``, 16 MB of floats that go to every task: finding the pivots and looking through the
files then cost about the same. A file of more than ``block`` entries
is cut into blocks, and every pair of its blocks is one group; so no task
holds more than two blocks and no pair of a file is left out.

Edge cases: null vectors, other lengths than ``dim``, null, NaN or infinite entries and
all-zero vectors are not usable and left out; identical vectors have cosine 1; ties go to the
smaller id; a collection of one vector gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

MAX_PIVOTS, BLOCK = 65_536, 12_000
FEW = 0  # for those who set it; no number of vectors changes the method
_INDEX = "id long, vec binary, pivots binary, least int, bound float, posts array<int>"


def _usable(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("id"), batch.column("v")
            sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1)
            at = np.flatnonzero(sizes == dim)
            picked = vectors.take(pa.array(at)).flatten()
            m = picked.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            ok = np.isfinite(m).all(1) & (m != 0).any(1)
            m, at = m[ok] + np.float32(0), at[ok]  # adding 0 makes -0 plain
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([r.tobytes() for r in m], pa.binary())], ["id", "vec"])

    return run


def unit_rows(vecs: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(vecs), np.float32).reshape(len(vecs), -1).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the ``prefix`` pivots of the largest products with each row of ``unit``, in order."""
    out = []
    for i in range(0, len(unit), 1000):
        close = unit[i : i + 1000] @ pivots.T
        few = np.argpartition(close, len(pivots) - prefix, axis=1)[:, len(pivots) - prefix :]
        out.append(np.take_along_axis(few, np.argsort(-np.take_along_axis(close, few, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, prefix), np.int64)


def shared_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a (n, m) and each of its rows of b (n, r, m): the sum over shared pivots of the
    smaller remaining rank (first place: m). The footrule distance is a constant minus twice this."""
    left = (a.shape[1] - np.arange(a.shape[1])).astype(np.uint8)
    same = a[:, None, :, None] == b[:, :, None, :]
    return (same * np.minimum(left[:, None], left[None, :])).sum((2, 3), dtype=np.int64)


def _indexed(pivots: np.ndarray, prefix: int, posts: int, depth: int, k: int):
    pivots = pivots.astype(np.float32)
    own = nearest_pivots(pivots, pivots, prefix).astype(np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 10_000):
                part = batch.slice(i, 10_000)
                unit = unit_rows(part.column("vec").to_pylist()).astype(np.float32)
                order = nearest_pivots(unit, pivots, prefix)
                least, bound = np.ones(len(order), np.int64), np.full(len(order), -2, np.float32)
                met = np.ones((len(order), posts), bool)
                if depth < prefix and len(order):
                    gain = np.concatenate([shared_ranks(o.astype(np.uint16), own[o]) for o in np.array_split(order, max(1, len(order) // 200))])
                    least = np.maximum(1, np.sort(gain, axis=1)[:, prefix - depth])
                    met = gain[:, :posts] >= least[:, None]
                if posts >= k and len(order):  # of the pivots that are surely met, but for itself
                    close = np.einsum("ij,ikj->ik", unit, pivots[order[:, :posts]])
                    close[~met | (close > 0.999999)] = -2
                    bound = np.sort(close, axis=1)[:, posts - k]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("vec"), pa.array([o.tobytes() for o in order.astype(np.uint16)], pa.binary()), pa.array(least, pa.int32()), pa.array(bound, pa.float32()), pa.array(list(order[:, :posts].astype(np.int32)), pa.list_(pa.int32()))],
                    ["id", "vec", "pivots", "least", "bound", "posts"],
                )

    return run


def places_table(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pivots in the rows of ``order`` and, for each of them, its remaining rank in every row
    (first place: the length of the prefix; absent: 0); a last row of zeros for other pivots."""
    m = order.shape[1]
    pivots, at = np.unique(order, return_inverse=True)
    left = np.zeros((len(pivots) + 1, len(order)), np.uint8 if m <= 22 else np.uint16)
    left[at.reshape(order.shape), np.arange(len(order))[:, None]] = m - np.arange(m)
    return pivots, left


def footrule_near(a: np.ndarray, least: np.ndarray, table: tuple[np.ndarray, np.ndarray], earlier: np.ndarray, posts: int, also: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, column): for each prefix in the rows of a the rows of the table whose shared remaining
    ranks are ``least`` or more, but for those that share a file before: ``earlier`` marks the pivots
    of a whose files come first. Only where ``also`` holds."""
    pivots, left = table
    m = a.shape[1]
    at = np.minimum(np.searchsorted(pivots, a), len(pivots) - 1)
    at[pivots[at] != a] = len(pivots)
    gain, met = np.zeros((len(a), left.shape[1]), left.dtype), np.zeros((len(a), left.shape[1]), bool)
    for j in range(m):
        rank = left[at[:, j]]
        if j < posts and earlier[:, j].all():
            met |= rank > m - posts
        elif j < posts and earlier[:, j].any():
            met |= (rank > m - posts) & earlier[:, j, None]
        gain += np.minimum(rank, left.dtype.type(m - j), out=rank)
    return np.nonzero((gain >= least[:, None]) & ~met & also)


class _Side:
    """The vectors of one block of a file."""

    def __init__(self, group: pa.Table, at: np.ndarray, prefix: int):
        take = group.take(pa.array(at))
        self.ids, self.least, self.bound = take.column("id").to_numpy(), take.column("least").to_numpy().astype(np.int64), take.column("bound").to_numpy()
        self.order = np.frombuffer(b"".join(take.column("pivots").to_pylist()), np.uint16).reshape(len(at), prefix).astype(np.int64)
        self.unit = unit_rows(take.column("vec").to_pylist())
        self.short = self.unit.astype(np.float32)


def _best(a: _Side, b: _Side, pivot: int, k: int, posts: int) -> Iterator[tuple]:
    """(id, other, cosine) of the k best of b for each of a: ranked by footrule, reranked by cosine."""
    n, table = len(b.ids), places_table(b.order)
    front = a.order[:, :posts]
    turn = np.where((front == pivot).any(1), (front == pivot).argmax(1), posts)
    earlier = np.arange(front.shape[1]) < turn[:, None]
    bound = a.bound - np.float32(1e-5)
    alike = np.argsort(turn, kind="stable")  # rows with the same files before them stand together
    for i in range(0, len(a.ids), 128):
        some = alike[i : i + 128]
        close = a.short[some] @ b.short.T  # most of a file is within the limit, so all products at once
        row, col = footrule_near(a.order[some], a.least[some], table, earlier[some], posts, close >= bound[some, None])
        kept = a.ids[some[row]] != b.ids[col]
        row, col = row[kept], col[kept]
        near = close[row, col]
        if not len(row):
            continue
        # One number to sort by: the row, the distance, the column.
        packed = np.sort((row.astype(np.uint64) << np.uint64(52)) | ((1.5 - near).astype(np.float64) * 2**34).astype(np.uint64) << np.uint64(16) | col.astype(np.uint64))
        row, far, col = (packed >> np.uint64(52)).astype(np.int64), ((packed >> np.uint64(16)) & np.uint64(2**36 - 1)).astype(np.int64), (packed & np.uint64(0xFFFF)).astype(np.int64)
        start = np.searchsorted(row, row)
        last = np.minimum(start + k - 1, np.searchsorted(row, row, "right") - 1)
        kept = far <= far[last] + int(4e-6 * 2**34)  # rounding may make these equal to the k-th best
        row, col = row[kept], col[kept]
        exact = np.round(np.einsum("ij,ij->i", a.unit[some[row]], b.unit[col]), 6)
        order = np.lexsort((b.ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield a.ids[some[row[first]]], b.ids[col[first]], exact[first]


def _file(k: int, prefix: int, posts: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side, pivot = group.column("side").to_numpy(), group.column("pivot")[0].as_py()
        sides = {x: _Side(group, np.flatnonzero(side == x), prefix) for x in np.unique(side).tolist()}  # 0: first block, 1: second block, 2: a block with itself
        got = []
        for a, b in ((0, 1), (1, 0), (2, 2)):
            if a in sides and b in sides:
                got += _best(sides[a], sides[b], pivot, k, posts)
        out = [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(x) for x in out], ["id", "other", "cosine"])

    return run


def _files(index: DataFrame, block: int) -> DataFrame:
    """The postings with the pair of blocks in which they are compared."""
    pivot = F.explode("posts").alias("pivot")
    blocks = F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")
    cut = index.select(pivot).groupBy("pivot").agg(blocks).where("blocks > 1").collect()  # at most a row a pivot
    posted = index.select("id", "vec", "pivots", "least", "bound", pivot)
    if not cut:
        return posted.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"))
    known = F.broadcast(index.sparkSession.createDataFrame(cut, "pivot int, blocks int"))
    placed = posted.join(known, "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("its", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("its"), 2).when(F.col("mine") < F.col("its"), 0).otherwise(1)
    return placed.select("id", "vec", "pivots", "least", "bound", "pivot", F.least("mine", "its").alias("i"), F.greatest("mine", "its").alias("j"), side.alias("side"))


def most_similar(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, dim: int = 64,
    prefix: int = 22, posts: int = 12, depth: int = 22, per_root: int = 8, max_pivots: int = MAX_PIVOTS, block: int = BLOCK,
) -> DataFrame:
    """(id, rank, other, cosine): for every usable vector the k others of the highest cosine
    (double precision, rounded to 6 decimals, ties to the smaller id). Identical vectors are
    written out from their class, so a class of n copies gives n * k rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id is not null and v is not null")
    usable = stage(rows.mapInArrow(_usable(dim), "id long, vec binary").select("id", "vec", F.unhex(F.md5("vec")).alias("digest")), "vectors")
    classes = usable.groupBy("digest").agg(F.min("id").alias("rep"))
    members = stage(usable.select("id", "digest").join(classes, "digest").select("id", "rep"), "members")
    reps = usable.join(members.where("id = rep").select("id"), "id").dropDuplicates(["id"]).select("id", "vec")
    n = members.where("id = rep").select("id").distinct().count()
    wanted = min(n, max(64, min(max_pivots, 65_536, int(per_root * n**0.5))))
    sample = []
    if n:  # those of the smallest hashes, with some to spare, then cut to the number wanted: at most about max_pivots rows
        share = min(1.0, (wanted + 5 * wanted**0.5 + 20) / n)
        hashed = F.col("hash") <= F.lit(min(2**63 - 1, int(share * 2**63)))
        got = reps.select("vec", F.xxhash64("vec").bitwiseAND(F.lit(2**63 - 1)).alias("hash")).where(hashed).collect()
        sample = [bytes(r["vec"]) for r in sorted(got, key=lambda r: (r["hash"], bytes(r["vec"])))[:wanted]]
    first = Window.partitionBy("rep").orderBy("id")
    own = members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("rep", "id")
    if not sample:
        near = spark.createDataFrame([], "id long, other long, cosine double")
    else:
        prefix = min(prefix, len(sample))
        posts = min(posts, prefix)
        index = stage(reps.mapInArrow(_indexed(unit_rows(sample), prefix, posts, min(depth, prefix), k), _INDEX), "index")
        found = _files(index, block).groupBy("pivot", "i", "j").applyInArrow(_file(k, prefix, posts), "id long, other long, cosine double")
        best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
        near = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("id", "other", "cosine")
    near = stage(near, "near")
    # The k + 1 best members for each class, its own included; each member then leaves itself out.
    listed = near.join(own.select(F.col("rep").alias("other"), F.col("id").alias("member")), "other").select(F.col("id").alias("rep"), "member", "cosine")
    listed = listed.unionByName(own.select("rep", F.col("id").alias("member"), F.lit(1.0).alias("cosine")))
    order = Window.partitionBy("rep").orderBy(F.desc("cosine"), "member")
    tops = listed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    tops = tops.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "member", "cosine"))).alias("top"))
    each = members.join(tops, "rep").select("id", F.slice(F.filter("top", lambda x: x.member != F.col("id")), 1, k).alias("top"))
    return each.select("id", F.posexplode("top").alias("pos", "x")).select("id", (F.col("pos") + 1).alias("rank"), F.col("x.member").alias("other"), F.col("x.cosine").alias("cosine"))


def similar_pairs(neighbours: DataFrame, least: float = 0.85) -> DataFrame:
    """(vec_a, vec_b, cosine), vec_a < vec_b, of the pairs in ``neighbours`` at or above ``least``."""
    return neighbours.where(F.col("cosine") >= least).select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b"), "cosine").distinct()
