"""Long exact spans shared between records (problem 8).

Level-wise doubling. At the first level windows of ``start`` characters are taken at
content-chosen places (the smallest hash among the windows that fit into ``min_len``
characters), so two records that share ``min_len`` characters share a chosen window. Windows
repeated in another record mark the stretches in which a shared span can still lie; only
those are looked at again with windows of twice the length, up to ``min_len`` itself, where
every position of the surviving stretches is a window; before this dense level one at three
quarters of the length, at chosen places, sieves them once more. What repeats there is shared, and
runs of such windows are the maximal spans. Levels end at ``min_len``: windows longer than the span that
is asked for are not needed, as neighbouring windows of that length give the whole run.

Distribution: texts are hashed first and each distinct text is worked on once; all levels read
one exchange of the texts. A level is one exchange of window entries into buckets, whose number
follows the counted characters (``BUCKET`` of them each); whole buckets go to a task by their
number, which spreads them evenly, and a task settles one bucket after the other, so it holds one
at a time. Inside a task equal hashes of different records are settled before the exchange and
leave it as one entry, so a passage that a third of all records holds sends one entry a task,
not one a record. Entries travel as packed byte planes. Nothing is collected, broadcast or capped.

Windows are compared by a 64-bit polynomial hash within a bucket that a second, additive hash
chooses: a false meeting needs both. As buckets follow the data, a window is falsely shared with
a chance of at most ``BUCKET`` / 2**64, 2 in 10**13, at any size.

Edge cases: null texts and texts under ``min_len`` characters have no spans; a text that
other records repeat whole is one span over its length; repeated rows of one id count as one
record; input columns other than the named two are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLUSH = 4_000_000  # window entries a task holds before it packs them
BUCKET = 4_000_000  # characters of text a bucket of window entries stands for
MOST_TASKS = 20_000  # of an exchange of window entries; beyond, a task settles several buckets
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PACKED = "bucket int, hashes binary, keys binary, places binary, many binary"
_PLACES = "key long, places binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_hashes(points: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window of ``length`` points at each place (the last ``length - 1`` places
    hold what overlaps the end), built from windows of half the length."""
    power, size, h = _ODD, 1, _mix(points.astype(np.uint64) + np.uint64(1))
    total, done, scale = np.zeros(len(points), np.uint64), 0, np.uint64(1)
    need = length
    with np.errstate(over="ignore"):
        while need:
            if need & 1:  # append a block of ``size`` behind the ``done`` points so far
                shifted = np.zeros_like(h)
                shifted[: len(h) - done] = h[done:]
                total = total * power + shifted
                done += size
            need >>= 1
            if need:
                shifted = np.zeros_like(h)
                shifted[: len(h) - size] = h[size:]
                h = h * power + shifted
                power, size = power * power, size * 2
        return _mix(total * _ODD + scale)


def window_sums(points: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """A second hash of the windows at the places ``at``: what their points are mixed to, added up."""
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(points.astype(np.uint64) * _ODD + np.uint64(77)), dtype=np.uint64)))
        return _mix(total[at + length] - total[at])


def _running(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] at each i (shorter at the end), by doubling."""
    out, size = x.copy(), 1
    while size < width:
        step = min(size, width - size)
        if step < len(out):
            best(out[:-step], out[step:], out=out[:-step])
        size += step
    return out


def chosen_places(h: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is smallest among ``width`` windows for at least one start that is
    ok; every window a start covers is itself whole when the start is ok."""
    if width <= 1:
        return np.flatnonzero(ok)
    least = _running(h, width, np.minimum)
    least[~ok] = 0
    back = _running(least[::-1], width, np.maximum)[::-1]
    return np.flatnonzero((back == h) & (h > 0))


def _plane(x: np.ndarray) -> bytes:
    """Integers as the byte planes of their differences, which compress well in text order."""
    steps = np.diff(x, prepend=x.dtype.type(0))
    return zlib.compress(steps.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes(), 1)


def _unplane(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def _several(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run: whether it holds two different keys."""
    return np.minimum.reduceat(keys, starts[:-1]) != np.maximum.reduceat(keys, starts[:-1])


def _by_key(keys: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(keys):
        return
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    cuts = _runs(keys)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(keys[a]), places[a:b]


def _pack(h: np.ndarray, bucket: np.ndarray, keys: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Settle hashes that two records of this task share; send the rest, one entry for each
    settled hash, by bucket. Settled places travel along in rows without hashes."""
    if not len(h):
        return
    order = np.lexsort((h, bucket))
    new = (h[order][1:] != h[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
    starts = np.concatenate(([0], np.flatnonzero(new) + 1, [len(h)]))
    several, first = np.zeros(len(h), bool), np.zeros(len(h), bool)
    several[order] = np.repeat(_several(keys[order], starts), np.diff(starts))
    first[order[starts[:-1]]] = True
    send = ~several | first
    rows = {k: [] for k in ("bucket", "hashes", "keys", "places", "many")}
    for chosen, with_hash in ((send, True), (several, False)):
        at = np.flatnonzero(chosen)
        at = at[np.argsort(bucket[at], kind="stable")]  # within a bucket in the order of the texts, in which keys and places compress
        cuts = _runs(bucket[at]) if len(at) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            i = at[a:b]
            rows["bucket"].append(bucket[i[0]])
            rows["hashes"].append(h[i].tobytes() if with_hash else None)
            rows["keys"].append(_plane(keys[i]))
            rows["places"].append(_plane(places[i]))
            rows["many"].append(several[i].tobytes() if with_hash else None)
            if len(rows["bucket"]) == 1000:
                yield _packed_rows(rows)
                rows = {k: [] for k in rows}
    if rows["bucket"]:
        yield _packed_rows(rows)


def _packed_rows(rows: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows, pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in ("hashes", "keys", "places", "many")]]))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which windows occur in two records, by record: rows come in order of their bucket, and
    each bucket is settled when it is complete."""
    bucket, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["bucket"] != bucket:
                yield from _settled(held)
                held = []
            bucket = r["bucket"]
            held.append(r)
    if held:
        yield from _settled(held)


def _settled(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    parts, done = [], []
    for r in rows:
        row = _unplane(r["keys"], np.int64), _unplane(r["places"], np.int32)
        if r["hashes"] is None:
            done.append(row)
        else:
            parts.append((np.frombuffer(r["hashes"], np.uint64), *row, np.frombuffer(r["many"], bool)))
    if parts:
        h, keys, places, many = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        h, keys, places, many = h[order], keys[order], places[order], many[order]
        starts = _runs(h)
        shared = _several(keys, starts) | np.logical_or.reduceat(many, starts[:-1])
        keep = np.repeat(shared, np.diff(starts))
        done.append((keys[keep], places[keep]))
    if done:
        keys, places = (np.concatenate(x) for x in zip(*done))
        got = list(_by_key(keys, places))
        for i in range(0, len(got), 10_000):
            yield pa.RecordBatch.from_pydict(
                {"key": [k for k, _ in got[i : i + 10_000]], "places": [p.astype(np.int32).tobytes() for _, p in got[i : i + 10_000]]},
                pa.schema([("key", pa.int64()), ("places", pa.binary())]),
            )


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted (start, end) rows joined where they touch or overlap."""
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    ends = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(spans) - 1]))
    return np.column_stack((spans[new, 0], reach[ends]))


def _level(length: int, min_len: int, before: int | None, buckets: int):
    """The map side of one level. Batches hold key, text and, after the first level, the
    places that repeated at length ``before``."""
    width = min_len - length + 1

    def stretches(points: np.ndarray, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The parts of a text in which a span can still lie, and the repeated windows in it."""
        places = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in found])).astype(np.int64)
        return places, _merged(np.column_stack((np.maximum(0, places - (min_len - before)), np.minimum(len(points), places + min_len))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            earlier = batch.column("found").to_pylist() if before else None
            for i in range(0, len(texts), 256):
                parts, owners, begins, repeated = [], [], [], []  # parts of texts, their texts, their places in them
                for j, t in enumerate(texts[i : i + 256], i):
                    points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                    if len(points) < min_len:
                        continue
                    places, spans = stretches(points, earlier[j]) if before else (None, [(0, len(points))])
                    for a, b in spans:
                        parts.append(points[a:b]), owners.append(j), begins.append(a)
                        if before:
                            mark = np.zeros(b - a, bool)
                            mark[places[np.searchsorted(places, a) : np.searchsorted(places, b)] - a] = True
                            repeated.append(mark)
                if not parts:
                    continue
                points, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
                at0 = np.cumsum(sizes) - sizes
                ok = np.zeros(len(points), bool)  # starts of a span of min_len characters that can be shared
                for begin, size in zip(at0, sizes):
                    ok[begin : max(begin, begin + size - min_len + 1)] = True
                if before:
                    ok &= _chosen_repeats(window_hashes(points, before), np.concatenate(repeated), min_len - before + 1)
                h = window_hashes(points, length)
                at = chosen_places(h, ok, width)
                part = np.searchsorted(at0, at, side="right") - 1
                bucket = (window_sums(points, length, at) % np.uint64(buckets)).astype(np.int32)
                held.append((h[at], bucket, keys[np.array(owners)[part]], (at - at0[part] + np.array(begins)[part]).astype(np.int32)))
                n += len(at)
                if n >= FLUSH:
                    yield from _pack(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
        if held:
            yield from _pack(*(np.concatenate(x) for x in zip(*held)))

    return run


def _chosen_repeats(h: np.ndarray, repeated: np.ndarray, width: int) -> np.ndarray:
    """Starts whose chosen window, the one of the smallest hash, is a repeated one. Two records
    that share the span at a start choose the same window in it, so other starts are out."""
    none = np.uint64(2**64 - 1)
    least = _running(np.where(repeated, h, none), width, np.minimum)
    return (least == _running(h, width, np.minimum)) & (least < none)


def _to_spans(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends = [], [], []
            for key, found in zip(batch.column("key").to_pylist(), batch.column("found").to_pylist()):
                places = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in found]).astype(np.int64))
                for a, b in _merged(np.column_stack((places, places + min_len))):
                    keys.append(key), starts.append(int(a)), ends.append(int(b))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["rep", "span_start", "span_end"])

    return run


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200, start: int | None = None) -> DataFrame:
    """(id, span_start, span_end, n_chars): the maximal runs of characters that lie in a span
    of ``min_len`` characters which another record holds too. ``start`` is the window length
    of the first level, doubled until ``min_len`` (default: half of it)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).where(
        F.col("key").isNotNull() & (F.length("text") >= min_len)
    )
    copies = texts.select("key", F.unhex(F.md5("text")).alias("digest"), F.length("text").cast("long").alias("n_chars"))
    groups = copies.groupBy("digest").agg(F.min("key").alias("rep"), (F.max("key") != F.min("key")).alias("copied"), F.max("n_chars").alias("n_chars"))
    reps = groups.select(F.col("rep").alias("key"))
    lengths = [min_len]
    while lengths[0] > (start or max(1, min_len // 2)):
        lengths.insert(0, (lengths[0] + 1) // 2)
    if len(lengths) > 1 and lengths[-2] < (sieve := min_len - min_len // 4):
        lengths.insert(-1, sieve)
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET))
    tasks = min(buckets, MOST_TASKS)
    found = None
    for i, length in enumerate(lengths):
        before = lengths[i - 1] if i else None
        if before is None:
            work = texts.join(reps.hint("merge"), "key").select("key", "text")
        else:
            work = texts.hint("merge").join(found, "key").select("key", "text", "found")
        packed = work.mapInArrow(_level(length, min_len, before, buckets), _PACKED)
        spread = packed.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket")
        places = spread.mapInArrow(_settle, _PLACES)
        found = places.groupBy("key").agg(F.collect_list("places").alias("found"))
    spans = found.mapInArrow(_to_spans(min_len), "rep long, span_start long, span_end long")
    by_rep = groups.where("copied").select("rep", F.lit(0).cast("long").alias("span_start"), F.col("n_chars").alias("span_end")).unionByName(
        spans.join(groups.where("copied").select("rep"), "rep", "left_anti")
    )
    members = copies.join(groups.select("digest", "rep"), "digest").select("key", "rep", "n_chars").distinct()
    return members.join(by_rep, "rep").select(F.col("key").alias(id_col), "span_start", "span_end", "n_chars")


def shared_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200) -> DataFrame:
    """(id, n_spans, shared_chars, n_chars, shared_share) for each record that shares a span."""
    spans = shared_spans(docs, id_col, text_col, min_len)
    shared = F.sum(F.col("span_end") - F.col("span_start"))
    return spans.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_spans"), shared.alias("shared_chars"), F.max("n_chars").alias("n_chars"), F.round(shared / F.max("n_chars"), 6).alias("shared_share")
    )
