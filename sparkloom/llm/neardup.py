"""Near-duplicate records with small edits (problem 3).

Byte-position inverted index with count filtering. A record is seen as a sparse array of bytes
over 2**24 positions: the 32-bit hash of each of its distinct word shingles gives a position and
the byte there, so edits, insertions and moved passages change only the bytes of the shingles
they touch. All positional bytes are put in one order, rare ones first, and a record of n of them
is posted under its first n - o + c, where o = ceil(t n) is what it shares at least with any
record of Jaccard similarity t or more. Two such records then share at least c of the posted
positional bytes (all they share, if that is fewer): the guaranteed minimum. Shared positional bytes
are tallied for each pair over all lists, pairs that reach the minimum are retained, and these are
verified on the whole sets. No pair at or over the threshold is lost.

Within a list a pair is counted only if it passes bounds that no pair at the threshold fails: the
ratio of the sizes, the bytes left behind the place at which they meet, and the places in which
parity sketches differ (at most the size of the symmetric difference).

Distribution: records with equal sets are one class, known by a digest. A task posts each class
once for every ``FLUSH`` postings, and a bucket keeps it once, so copies, however many, are not
compared with each other. The order comes from counts over all records in ``SLOTS`` slots of positional bytes (4
MB, whatever the data). Postings travel packed, in buckets whose number follows the counted
postings; a bucket gets the size and the sketch of a record once. A list that may hold more than ``LIST`` records is cut into groups before it is sent,
and each pair of groups is a cell of its own in some bucket, so a byte that a third of all
records hold is many tasks' work; no list is shortened. Texts are never shuffled, sets only for
records in retained pairs. Work follows the pairs that share a rare positional byte, so on texts of
a closed set of phrases it grows faster than the number of records.

Edge cases: null or blank texts and texts with fewer than ``least`` distinct shingles are left
out (``short_members`` gives them classes); records with the same id are one record; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, stage
from .textform import words

SLOTS, BLOCKS = 1 << 20, 64  # counts of positional bytes, and the parts in which they are added up
LEAST_SHARED = 3  # posted positional bytes that a pair must share
BITS, HALF, QUARTER = 512, 120, 55  # of the parity sketch, and the shingles up to which it is folded to a half and a quarter
LIST = 20_000  # records of one list that one task compares
POSTS, FLUSH, MOST_TASKS = 1_000_000, 2_000_000, 20_000  # postings a bucket, held by a task, tasks of the exchange
BLOCK = 500_000  # pairs looked at together
SLACK = 1e-6  # bounds are loosened by this, so rounding drops no pair
_FEATURES = "id long, name string, digest binary, mark long, n int, keys binary"
_POSTS = "bucket int, keys binary, cells binary, owners binary, places binary, marks binary, sizes binary, sketches binary"
_PAIRS = "a long, b long, shared long, need int"


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Hashes of the distinct runs of ``size`` consecutive words of texts, as uint32 (two different
    runs of one record share a value once in 4 billion)."""

    def __init__(self, size: int):
        self.size, self.known = size, _Hashes()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(values, owners): the sorted values of each text, with the number of their text."""
        lists = [words(t) for t in texts]
        many = np.array([len(w) for w in lists], np.int64)
        h = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lists)), np.uint64, int(many.sum()))
        n = len(h) - self.size + 1
        if n < 1:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            run = h[:n].copy()
            for i in range(1, self.size):
                run = (run ^ (run >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
            run ^= run >> np.uint64(32)
            run *= np.uint64(0xBF58476D1CE4E5B9)
        owner = np.repeat(np.arange(len(lists)), many)
        whole = owner[:n] == owner[self.size - 1 :]  # the run ends in the text in which it begins
        both = np.unique((owner[:n][whole].astype(np.uint64) << np.uint64(32)) | (run[whole] >> np.uint64(32)))
        return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.int64)


def _parity(every: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each record, at each of ``BITS`` places, whether it has an odd number of shingles there.
    The parts of small records are added up and the rest is left 0, which compresses."""
    with np.errstate(over="ignore"):
        place = (every * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS.bit_length() + 1)
    place = (place % np.where(n <= QUARTER, BITS // 4, np.where(n <= HALF, BITS // 2, BITS))[owner]).astype(np.int64)
    odd = np.bincount(owner * BITS + place, minlength=len(n) * BITS).reshape(len(n), BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def _folds(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of 64-bit words folded to a half and to a quarter."""
    half = sketch[:, : sketch.shape[1] // 2] ^ sketch[:, sketch.shape[1] // 2 :]
    return half, half[:, : half.shape[1] // 2] ^ half[:, half.shape[1] // 2 :]


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of ``values`` that end at ``ends`` as binary values."""
    offsets = np.append(0, ends).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _features(size: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                every, owner = shingles(part.column("text").to_pylist())
                n = np.bincount(owner, minlength=part.num_rows)
                at = np.flatnonzero(n >= max(least, 1))
                if not len(at):
                    continue
                kept = np.isin(owner, at)
                every, owner, n = every[kept], np.searchsorted(at, owner[kept]), n[at]
                ends = np.cumsum(n)
                digests = [xxhash.xxh128_digest(every[b - m : b].tobytes()) for b, m in zip(ends, n)]
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(rows), part.column("name").take(rows), pa.array(digests, pa.binary()),
                     pa.array(np.frombuffer(b"".join(digests), np.int64)[::2]), pa.array(n, pa.int32()), _binaries(every, ends)],
                    ["id", "name", "digest", "mark", "n", "keys"],
                )

    return run


def _slot(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint32(32 - SLOTS.bit_length() + 1)


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(SLOTS, np.int64)
    for batch in batches:
        if batch.num_rows:
            held += np.bincount(_slot(np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint32)), minlength=SLOTS)
    parts = np.minimum(held, 2**31 - 1).astype(np.int32).reshape(BLOCKS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "counts"])


def _added(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in group.column("counts").to_pylist())
    return pa.table([pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], ["block", "counts"])


def slot_counts(features: DataFrame) -> np.ndarray:
    """How many positional bytes of all records fall into each of ``SLOTS`` slots (4 MB)."""
    sums = features.select("keys").mapInArrow(_tallies, "block int, counts binary").groupBy("block").applyInArrow(_added, "block int, counts binary")
    return np.frombuffer(b"".join(r["counts"] for r in sorted(sums.collect(), key=lambda r: r["block"])) or bytes(4 * SLOTS), np.int32)


def shared_at_least(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many of its n shingles a record shares at least with one at the threshold."""
    return np.ceil(threshold * n - SLACK).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _posted(threshold: float, counts: np.ndarray, least_shared: int, buckets: int, most: int):
    groups = -(-np.maximum(counts, 1).astype(np.int64) // most)  # into which the lists of a slot are cut

    def pack(marks: np.ndarray, n: np.ndarray, every: np.ndarray) -> Iterator[pa.RecordBatch]:
        owner, first = np.repeat(np.arange(len(n)), n), np.zeros(len(n), bool)
        first[np.unique(np.stack([marks, n]), axis=1, return_index=True)[1]] = True  # a class once
        every, owner, marks, n = every[first[owner]], (np.cumsum(first) - 1)[owner[first[owner]]], marks[first], n[first]
        sketches = _parity(every, owner, n)
        sort = np.lexsort((every, counts[_slot(every)], owner))
        at = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n)
        needed = shared_at_least(n, threshold)
        taken = at < (n - needed + np.minimum(least_shared, needed))[owner]
        keys, owner, at = every[sort][taken], owner[taken], at[taken]
        cells = np.zeros(len(keys), np.uint32)  # 0: the whole list; else 1 + 4 * (lower * groups + upper) + side
        many = groups[_slot(keys)]
        if (many > 1).any():  # a copy for each group of the list
            hot = np.repeat(np.arange(len(keys)), many)
            g = many[hot].astype(np.int64)
            mine = (_mixed(marks[owner[hot]].astype(np.uint64)) % g.astype(np.uint64)).astype(np.int64)
            its = np.arange(len(hot)) - np.repeat(np.cumsum(many) - many, many)
            side = np.where(mine == its, 2, np.where(mine < its, 0, 1))
            cells = np.where(g > 1, 1 + 4 * (np.minimum(mine, its) * g + np.maximum(mine, its)) + side, 0).astype(np.uint32)
            keys, owner, at = keys[hot], owner[hot], at[hot]
        place = _mixed((keys.astype(np.uint64) << np.uint64(32)) | ((cells.astype(np.uint64) + np.uint64(3)) >> np.uint64(2)))
        bucket = (place % np.uint64(buckets)).astype(np.int64)
        sort = np.argsort(bucket, kind="stable")
        bucket, keys, cells, owner, at = bucket[sort], keys[sort], cells[sort], owner[sort], at[sort]
        cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else [0]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            which, back = np.unique(owner[a:b], return_inverse=True)
            rows.append((int(bucket[a]), keys[a:b].tobytes(), cells[a:b].tobytes(), back.astype(np.int32).tobytes(), at[a:b].astype(np.int32).tobytes(), marks[which].tobytes(), n[which].astype(np.int32).tobytes(), sketches[which].tobytes()))
        for i in range(0, len(rows), 1000):
            cols = list(zip(*rows[i : i + 1000]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], [x.split()[0] for x in _POSTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                held.append((part.column("mark").to_numpy(), part.column("n").to_numpy().astype(np.int64), np.frombuffer(b"".join(part.column("keys").to_pylist()), np.uint32)))
                size += len(held[-1][2])
                if size >= FLUSH:
                    yield from pack(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if held:
            yield from pack(*(np.concatenate(x) for x in zip(*held)))

    return run


def _met(threshold: float, least_shared: int):
    """The tally of one partition of buckets, which come one after the other: for each pair that
    passes every bound, in how many lists of the bucket it meets, and in how many it must."""
    least, most = threshold / (1 + threshold), (1 - threshold) / (1 + threshold)  # of both sizes: shared, different

    def differ(sketch: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.bitwise_count(sketch[0][a] ^ sketch[0][b]).astype(np.int16)
        for word in sketch[1:]:
            total += np.bitwise_count(word[a] ^ word[b])
        return total

    def pairs(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        read = lambda c, kind: [np.frombuffer(r[c], kind) for r in rows]
        owners, marks = read("owners", np.int32), read("marks", np.int64)
        begins = np.cumsum([0, *map(len, marks[:-1])])
        owner = np.concatenate([o + b for o, b in zip(owners, begins)])
        marks, sizes = np.concatenate(marks), np.concatenate(read("sizes", np.int32)).astype(np.int64)
        (marks, sizes), first, back = np.unique(np.stack([marks, sizes]), axis=1, return_index=True, return_inverse=True)
        owner = back.ravel()[owner]  # a class once
        sketch = np.concatenate(read("sketches", np.uint64)).reshape(-1, BITS // 64)[first]
        half, quarter = _folds(sketch)
        sketch, half, quarter = ([np.ascontiguousarray(w) for w in x.T] for x in (sketch, half, quarter))  # by words
        key, cell, at = np.concatenate(read("keys", np.uint32)), np.concatenate(read("cells", np.uint32)), np.concatenate(read("places", np.int32)).astype(np.int64)
        side = np.where(cell > 0, (cell.astype(np.int64) - 1) & 3, 2)
        line = (key.astype(np.uint64) << np.uint64(32)) | ((cell.astype(np.uint64) + np.uint64(3)) >> np.uint64(2))
        sort = np.lexsort((owner, sizes[owner], line))
        line, owner, at, side = line[sort], owner[sort], at[sort], side[sort]
        fresh = np.concatenate(([True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])))
        line, owner, at, side = line[fresh], owner[fresh], at[fresh], side[fresh]
        n = sizes[owner]
        new = np.concatenate(([True], line[1:] != line[:-1]))
        lists = np.cumsum(new)
        wide = int(n.max()) + 2
        here, extra = np.arange(len(line)), least_shared - 1  # a list need not be the first in which a pair meets
        # The largest size to be met: by the ratio, and by what is left behind the place of the smaller of two.
        upper = np.minimum(np.floor(n / threshold + SLACK), np.floor((n - at + extra + SLACK) / least) - n).astype(np.int64)
        end = np.searchsorted(lists * wide + n, lists * wide + np.clip(upper, 0, wide - 1), "right")
        left = here[(n - at + extra >= 2 * least * n - SLACK) & (end > here + 1)]  # the smaller of two
        many = end[left] - left - 1
        total = np.cumsum(many)
        needed = np.minimum(shared_at_least(sizes, threshold), least_shared)
        i = 0
        while i < len(left):
            until = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + BLOCK, "right")))
            a, m = np.repeat(left[i:until], many[i:until]), many[i:until]
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
            i = until
            both = n[a] + n[b]
            ok = np.minimum(n[a] - at[a], n[b] - at[b]) + extra >= least * both - SLACK
            ok &= (side[a] == 2) | (side[a] != side[b])
            a, b, limit = owner[a[ok]], owner[b[ok]], np.floor(most * both[ok] + SLACK)
            for fold, above in ((quarter, 0), (half, QUARTER), (sketch, HALF)):  # a fold is held against what both have at least
                ok = differ(fold, a, b) <= limit
                if above:
                    ok |= np.minimum(sizes[a], sizes[b]) <= above
                a, b, limit = a[ok], b[ok], limit[ok]
            if len(a):
                a, b = np.minimum(a, b), np.maximum(a, b)  # records are in order of their marks
                found, first, shared = np.unique(a * len(marks) + b, return_index=True, return_counts=True)
                need = np.minimum(needed[a], needed[b])[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks[found // len(marks)]), pa.array(marks[found % len(marks)]), pa.array(shared, pa.int64()), pa.array(need, pa.int32())], ["a", "b", "shared", "need"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["bucket"] != bucket:
                    yield from pairs(held)
                    held = []
                bucket = r["bucket"]
                held.append(r)
        if held:
            yield from pairs(held)

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, shared, either) from pairs with both sets."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)

            def marked(c: str, part=part) -> tuple[np.ndarray, np.ndarray]:
                sets = [np.frombuffer(x, np.uint32) for x in part.column(c).to_pylist()]
                n = np.array([len(x) for x in sets])
                return (np.repeat(np.arange(len(sets)), n).astype(np.uint64) << np.uint64(32)) | np.concatenate(sets), n

            if part.num_rows:
                (x, nx), (y, ny) = marked("x"), marked("y")
                shared = np.bincount((np.intersect1d(x, y, assume_unique=True) >> np.uint64(32)).astype(np.int64), minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(shared, pa.int64()), pa.array(nx + ny - shared, pa.int64())], ["a", "b", "shared", "either"])


def near_duplicates(
    records: DataFrame, id_col: str, name_col: str, text_col: str, size: int = 5, threshold: float = 0.8, least: int = 1, least_shared: int = LEAST_SHARED, most: int = LIST
) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members`` (name, rep) gives each record its class of equal shingle
    sets, represented by the smallest id; ``links`` (a, b, shared, similarity), a < b, are the
    pairs of representatives whose Jaccard similarity over word shingles is at least
    ``threshold``. ``id_col`` is a unique number, ``name_col`` the record's name; ``most`` is the
    length from which a list is cut into groups."""
    spark = records.sparkSession
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(name_col).cast("string").alias("name"), F.col(text_col).alias("text")).where(
        F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("text").isNotNull()
    )
    feats = stage(rows.mapInArrow(_features(size, least), _FEATURES), "features")
    classes = feats.groupBy("digest", "mark").agg(F.min("id").alias("rep"))
    members = feats.select("digest", "name").join(classes, "digest").select("name", "rep").distinct()
    posts = feats.agg(F.sum(F.col("n") - F.ceil(threshold * F.col("n")) + least_shared)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(posts) // POSTS))
    tasks = min(buckets, MOST_TASKS)
    packed = feats.select("mark", "n", "keys").mapInArrow(_posted(threshold, slot_counts(feats), least_shared, buckets, most), _POSTS)
    lists = packed.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket")
    tally = lists.mapInArrow(_met(threshold, least_shared), _PAIRS).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"))
    one, two = (classes.select(F.col("mark").alias(m), F.col("rep").alias(r)) for m, r in (("a", "one"), ("b", "two")))
    named = tally.where("shared >= need").join(one, "a").join(two, "b")
    kept = stage(named.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).where("a < b").distinct(), "pairs")
    concerned = kept.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = feats.select("id", "keys").join(concerned, "id").dropDuplicates(["id"])
    both = kept.join(sets.select(F.col("id").alias("a"), F.col("keys").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("keys").alias("y")), "b")
    links = both.mapInArrow(_verified, "a long, b long, shared long, either long")
    return members, links.where(F.col("shared") >= threshold * F.col("either")).select("a", "b", "shared", (F.col("shared") / F.col("either")).alias("similarity"))


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [words(t) for t in batch.column("text").to_pylist()]
        same = [xxhash.xxh128_hexdigest(" ".join(w)) if w else None for w in lists]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("name"), pa.array(same, pa.string())], ["id", "name", "same"])


def short_members(records: DataFrame, members: DataFrame, id_col: str, name_col: str, text_col: str) -> DataFrame:
    """(name, rep) of the records whose name has no class in ``members``, because their texts are
    null, blank or have too few shingles: equal word lists are one class, represented by the
    smallest id; a record without words is a class of its own."""
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(name_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("name").isNotNull()).join(members.select("name").distinct(), "name", "left_anti")
    lists = stage(rows.select("id", "name", "text").mapInArrow(_word_lists, "id long, name string, same string"), "short")
    alike = F.struct(F.col("same").alias("same"), F.when(F.col("same").isNull(), F.col("name")).alias("own"))
    keyed = lists.select("id", "name", F.to_json(alike).alias("key"))
    return keyed.select("name", "key").distinct().join(keyed.groupBy("key").agg(F.min("id").alias("rep")), "key").select("name", "rep")


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of records (a < b by name) within a class or linked across classes."""
    one, two = members.select(F.col("name").alias("n1"), "rep"), members.select(F.col("name").alias("n2"), "rep")
    within = one.join(two, "rep").where("n1 < n2").select("n1", "n2")
    across = links.select("a", "b").join(one.withColumnRenamed("rep", "a"), "a").join(two.withColumnRenamed("rep", "b"), "b").where("n1 != n2")
    return within.unionByName(across.select("n1", "n2")).select(F.least("n1", "n2").alias("chunk_a"), F.greatest("n1", "n2").alias("chunk_b")).distinct()


def record_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(name, rep, group_id, n_links, group_size): one row per record. ``group_id`` is the
    smallest representative id of its connected component, ``n_links`` counts the classes
    linked to its own."""
    links = stage(links.select("a", "b"), "links")
    joined = connected(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    rows = members.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
    rows = rows.select("name", "rep", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    sizes = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return rows.join(sizes, "group_id").select("name", "rep", "group_id", "n_links", "group_size")
