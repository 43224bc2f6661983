"""Repeated passages by suffix arrays: every byte that a 200-byte string covers which also starts elsewhere goes.

1. Anchors: the place of the least hash among the 64-byte strings of a window is its anchor. Windows in a row that share
   one are a block; so each 200-byte string lies in one block, and what is equal has equal anchors wherever it is.
2. Anchors that occur once can't be in a string that occurs twice; their blocks go. Of the rest, blocks that are equal
   as a whole repeat as a whole. Both are counts by key, combined before the shuffle.
3. What remains are different blocks with one anchor, at the edges of passages and around edits. Their bytes meet by
   anchor and are sorted by a suffix array in two stages: the suffixes smaller than their successors directly, the
   others by scans of buckets. Neighbours whose common prefix has 200 bytes are repeats.
4. Where an anchor has too many different blocks for one task, each block is parted by how far before the anchor its
   windows start, in ranges of 64 places. What all windows of a range have in common is longer than the anchor, and is the
   part's anchor in its turn: steps 2 and 3 again, then with ranges of 32 places, down to single windows.
   As equal windows lie in equal ranges they still meet, and a block has few parts that stay, near the edge of what it shares.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, small_batches, texts, written

LENGTH, GRAM = 200, 64
#: Bytes whose blocks are found at once, and bytes of a suffix array.
CHUNK, ARRAY = 2_000_000, 1_500_000
#: An anchor with more different blocks has them parted, by ranges of 2**shift places.
CROWD, SHIFTS = 2048, (6, 5, 4, 3, 2, 1, 0)
NO_ID = -(2**63)
_RANDOM = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each place on, by doubling."""
    h, size = _RANDOM[raw], 1
    while size < GRAM:
        h = h[:-size] * np.uint64(pow(_BASE, size, 2**64)) + h[size:]
        size *= 2
    return _mixed(h)


def _anchored(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and of each window of LENGTH bytes the place of its anchor, the first of the least ones."""
    h = _grams(raw)
    least, size, width = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1, LENGTH - GRAM + 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    return h, (least & _LOW).astype(np.int64)


def blocks(raw: bytes, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first window, last window, hash of the anchor, hash of the block) in texts that end at ``ends``."""
    starts = np.concatenate([[0], ends[:-1]])
    at, k = 0, 0
    data = np.frombuffer(raw, np.uint8)
    while k < len(ends):
        # Whole texts of CHUNK bytes or so; a longer text is cut between windows.
        last = max(k, int(np.searchsorted(ends, at + CHUNK)) - 1)
        stop = min(int(ends[last]), at + 2 * CHUNK)
        upper = min(int(ends[last]), stop + LENGTH - 1) if stop < ends[last] else stop
        if upper - at >= LENGTH:
            h, anchor = _anchored(data[at:upper])
            place = np.arange(at, at + len(anchor))
            own = np.searchsorted(ends, place, side="right")
            inside = place + LENGTH <= ends[own]
            new = inside.copy()
            new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
            old = inside.copy()
            old[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
            first, final = np.flatnonzero(new), np.flatnonzero(old)
            keys = h[anchor[first]].view(np.int64).tolist()
            for a, b, key in zip((first + at).tolist(), (final + at).tolist(), keys, strict=True):
                yield a, b, key, xxhash.xxh3_64_intdigest(raw[a : b + LENGTH])
        if stop < ends[last]:
            at = stop
            k = last
        else:
            k = last + 1
            at = int(ends[last])
    assert len(starts) == len(ends)


def _binary(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a column of texts, one after the other, and where each ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return (column.buffers()[2] or pa.py_buffer(b""))[int(offsets[0]) : int(offsets[-1])].to_pybytes() if len(column) else b"", (offsets[1:] - offsets[0]).copy()


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """p: the first window and the number of further ones in one long."""
    for b in batches:
        raw, ends = _binary(b.column("text"))
        rows = np.array(list(blocks(raw, ends)) if len(ends) else [], dtype=object).reshape(-1, 4)
        first, final = rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64)
        own = np.searchsorted(ends, first, side="right")
        start = np.concatenate([[0], ends])[own]
        doc, tag = (b.column(c).to_numpy(zero_copy_only=False)[own] if len(own) else np.zeros(0, np.int64) for c in ("doc", "tag"))
        p = ((first - start) << 8) | (final - first)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 2].astype(np.int64)), pa.array(rows[:, 3].astype(np.uint64).view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(tag.astype(np.int64)), pa.array(p)], ["anchor", "block", "doc", "tag", "p"])


# ---- a suffix array in two stages


def _words(t: np.ndarray) -> np.ndarray:
    """The 5 bytes from each place on as a number; zeros stand behind the end."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(t), np.uint64)
    for k in range(5):
        out = (out << np.uint64(8)) | padded[k : k + len(t)]
    return out


def _direct(t: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` sorted by the ``depth`` bytes that follow, five at a time, each step on what is still tied."""
    words = np.concatenate([_words(t), np.zeros(depth + 5, np.uint64)])
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(new) - 1
    tied = np.flatnonzero(~new | np.concatenate([~new[1:], [False]]))
    for d in range(5, depth, 5):
        if not len(tied):
            break
        g = np.unique(group[tied], return_inverse=True)[1].astype(np.uint64) if tied[-1] >= 2**24 else group[tied].astype(np.uint64)
        key = (g << np.uint64(40)) | words[order[tied] + d]
        by = np.argsort(key, kind="stable")
        order[tied], key = order[tied][by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        # A group is numbered by the place of its first, so numbers keep their order.
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[~new | np.concatenate([~new[1:], [False]])]
    return order


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The suffixes of ``t`` (bytes; under 2**24 of them) in order of their first ``depth`` bytes; ties lie together.

    First stage: the suffixes smaller than their successors are sorted directly. Second: buckets, one for each first
    byte, are scanned in rising order; what stands before an entry and is larger than it goes to the end of
    its own bucket's front part. The front part of a bucket is so complete before it is scanned.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    symbol = t[edge]
    smaller = np.repeat(np.concatenate([symbol[:-1] < symbol[1:], [False]]), np.diff(np.append(edge, n)))
    back = _direct(t, np.flatnonzero(smaller), depth) if smaller.any() else np.zeros(0, np.int64)
    cuts = np.searchsorted(t[back], np.arange(257))
    front: list[list[np.ndarray]] = [[] for _ in range(256)]
    front[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave, whole = (np.concatenate(front[c]) if front[c] else np.zeros(0, np.int64)), []
        # Runs of one byte: each entry brings in the one before it.
        while len(wave):
            whole.append(wave)
            before = wave[wave > 0] - 1
            wave = before[t[before] == c]
        bucket = np.concatenate([*whole, back[cuts[c] : cuts[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        if len(before):
            first = t[before]
            by = np.argsort(first, kind="stable")
            kinds, at = np.unique(first[by], return_index=True)
            for x, part in zip(kinds, np.split(before[by], at[1:]), strict=True):
                front[x].append(part)
        front[c] = []
    return np.concatenate(out)


def common_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Of each pair of places the length of the common prefix, ``depth`` at most."""
    padded = np.concatenate([t, np.zeros(depth + 8, np.uint8)])
    length, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for d in range(0, depth, 8):
        if not len(open_):
            break
        same = words[a[open_] + d] == words[b[open_] + d]
        run = np.where(same.all(1), 8, same.argmin(1))
        length[open_] += run
        open_ = open_[run == 8]
    return np.minimum(length, depth)


def repeated_windows(parts: list[bytes], windows: list[int]) -> list[np.ndarray]:
    """Of each part the windows, among its first so many, whose LENGTH bytes also start elsewhere in the parts."""
    # Bytes of UTF-8 are never 255: each goes up by one, and zero ends a part.
    t = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1)
    size = np.array([len(p) + 1 for p in parts])
    start = np.cumsum(size) - size
    asked = np.zeros(len(t), bool)
    for s, w in zip(start.tolist(), windows, strict=True):
        asked[s : s + w] = True
    order = suffix_array(t)
    order = order[asked[order]]
    twice = common_prefix(t, order[:-1], order[1:]) >= LENGTH
    hit = np.zeros(len(t), bool)
    hit[order[:-1][twice]] = True
    hit[order[1:][twice]] = True
    return [np.flatnonzero(hit[s : s + w]) for s, w in zip(start.tolist(), windows, strict=True)]


def _spans(doc: list[int], tag: list[int], at: list[int], hits: list[np.ndarray]) -> pa.RecordBatch:
    """Windows in a row as one span of bytes."""
    rows = []
    for d, g, s, h in zip(doc, tag, at, hits, strict=True):
        if len(h):
            gap = np.flatnonzero(np.diff(h) > 1)
            for a, b in zip(h[np.concatenate([[0], gap + 1])].tolist(), h[np.concatenate([gap, [len(h) - 1]])].tolist(), strict=True):
                rows.append((d, g, s + a, s + b + LENGTH))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "tag", "lo", "hi"])


def _groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[dict]]:
    """Rows in order of their group, in lists of whole groups that hold ``least`` bytes or more, if there are as many."""
    held: list[dict] = []
    size = 0
    for b in batches:
        for r in b.to_pylist():
            if held and size >= least and r["anchor"] != held[-1]["anchor"]:
                yield held
                held, size = [], 0
            held.append(r)
            size += len(r["bytes"]) + 1
    if held:
        yield held


def _found_in(rows: list[dict], hits: list[np.ndarray]) -> pa.RecordBatch:
    one = [(r, h) for r, h in zip(rows, hits, strict=True) if r["n"] == 1]
    return _spans([r["doc"] for r, _ in one], [r["tag"] for r, _ in one], [r["first"] for r, _ in one], [h for _, h in one])


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays of ARRAY bytes or more, cut between anchors."""
    for rows in _groups(batches, ARRAY):
        yield _found_in(rows, repeated_windows([r["bytes"] for r in rows], [r["more"] + 1 for r in rows]))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with l: how many bytes of the block's first window stand before its anchor."""
    for b in batches:
        l = [int(_anchored(np.frombuffer(x, np.uint8))[1][0]) for x in b.column("bytes").to_pylist()]  # noqa: E741
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(l, pa.int64())], [*b.schema.names, "l"])


def _parted(shift: int):
    """Each block in parts, by ranges of 2**shift bytes before the anchor. What all windows of a range have in common is the part's anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                l, raw, at = r["l"], r["bytes"], 0  # noqa: E741
                while at <= r["more"]:
                    low = (l - at) >> shift << shift
                    last = min(r["more"], l - low)
                    high = min(low + (1 << shift) - 1, LENGTH - GRAM)
                    core, part = raw[l - low : l + LENGTH - high], raw[at : last + LENGTH]
                    # Seeded by the range, as equal bytes of another range are another anchor.
                    anchor = xxhash.xxh3_64_intdigest(core, seed=low)
                    rows.append((anchor, xxhash.xxh3_64_intdigest(part), r["n"], r["doc"], r["tag"], r["first"] + at, last - at, part, l - at))
                    at = last + 1
            columns = list(zip(*rows, strict=True)) or [()] * 9
            hashes = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[:2]]
            kinds = (*[pa.int64()] * 5, pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([*hashes, *[pa.array(c, t) for c, t in zip(columns[2:], kinds, strict=True)]], ["anchor", "block", "n", "doc", "tag", "first", "more", "bytes", "l"])

    return run


def _released(spark: SparkSession) -> None:
    """Let go of the shuffle files of what has been written down."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spans(docs: DataFrame) -> DataFrame:
    """doc, tag, lo, hi: spans of bytes to remove, which may overlap, of texts (doc, tag, text)."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    found = docs.select("doc", "tag", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= LENGTH).mapInArrow(_block_rows, "anchor long, block long, doc long, tag long, p long")
    again = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    again = written(again)  # so that the join deals out both sides itself, and a common anchor's part can be split
    found = written(found.join(again, "anchor", "left_semi"))
    remove(again)
    _released(spark)

    key = ["anchor", "block"]
    each = written(found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("doc", "tag", "p")]))
    place = ["tag", F.shiftright("p", 8).alias("first"), F.col("p").bitwiseAND(255).alias("more")]
    equal = found.join(each.where("n > 1").select(*key), key).select("doc", *place)
    whole = written(equal.select("doc", "tag", F.col("first").alias("lo"), (F.col("first") + F.col("more") + LENGTH).alias("hi")))
    remove(found)

    open_ = written(_open(each).select("anchor", "crowd", "n", "doc", *place))
    remove(each)
    _released(spark)
    # The bytes are taken where a block meets its text, so the text goes no further.
    bytes_ = F.substring(F.col("text").cast("binary"), (F.col("first") + 1).cast("int"), (F.col("more") + LENGTH).cast("int"))
    with_text = open_.join(docs, ["doc", "tag"]).select("anchor", "crowd", "n", "doc", "tag", "first", "more", bytes_.alias("bytes")).dropDuplicates(["doc", "tag", "first", "anchor"])
    crowded = open_.where(F.col("crowd") > CROWD).limit(1).count() > 0
    sorted_out = lambda rows: rows.drop("crowd", "l").repartition("anchor").sortWithinPartitions("anchor", "doc", "tag", "first").mapInArrow(_sorted_out, "doc long, tag long, lo long, hi long")
    result = whole.unionByName(sorted_out(with_text.where(F.col("crowd") <= CROWD)))

    many = None
    for shift in SHIFTS if crowded else ():
        if many is None:
            kind = "anchor long, crowd long, n long, doc long, tag long, first long, more long, bytes binary"
            many = with_text.where(F.col("crowd") > CROWD).mapInArrow(_placed, f"{kind}, l long")
        parts = written(many.drop("crowd").mapInArrow(_parted(shift), "anchor long, block long, n long, doc long, tag long, first long, more long, bytes binary, l long"))
        one = F.struct("doc", "tag", "first", "more", "bytes", "l")
        each = written(parts.groupBy(*key).agg(F.sum("n").alias("n"), F.first(one).alias("one")).select(*key, "n", "one.*"))
        equal = parts.where("n = 1").join(each.where("n > 1").select(*key), key)
        result = result.unionByName(written(equal.select("doc", "tag", F.col("first").alias("lo"), (F.col("first") + F.col("more") + LENGTH).alias("hi"))))
        remove(parts)
        open_ = written(_open(each).select("anchor", "crowd", "n", "doc", "tag", "first", "more", "bytes", "l"))
        remove(each)
        result = result.unionByName(sorted_out(open_.where(F.col("crowd") <= CROWD)))
        many = open_.where(F.col("crowd") > CROWD)
        if not many.limit(1).count():
            break
    return result


def _open(each: DataFrame) -> DataFrame:
    """The different blocks whose anchor has several, with their number as crowd."""
    crowd = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    return each.join(written(crowd), "anchor")


def merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Spans as maximal runs; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, raw, cut in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("cut"), strict=True):
            runs = []
            if cut.is_valid:
                pairs = cut.values
                runs = merged(pairs.field("lo").to_numpy(), pairs.field("hi").to_numpy())
            kept, at = hashlib.sha256(), 0
            for a, z in runs:
                kept.update(raw[at:a])
                at = z
            kept.update(raw[at:])
            rows.append((i, len(raw), sum(z - a for a, z in runs), len(runs), kept.hexdigest(), [{"lo": a, "hi": z} for a, z in runs]))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (spans of bytes).

    A byte goes if a string of LENGTH bytes covers it that also starts anywhere else, in the same text or another; texts
    are judged as given. A null text is empty; texts under LENGTH bytes lose nothing. Rows that repeat whole are
    two places, so they lose all from LENGTH bytes on. A null doc_id is an id like others. No rows give no rows.
    Rows of one doc_id and different texts are told apart by a hash of 64 bits.
    """
    t = texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("tag"), "text")
    cut = written(spans(t.select("doc", "tag", "text")).groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("cut")))
    _released(docs.sparkSession)  # the texts that went by anchor, before they go by document
    both = t.join(cut, ["doc", "tag"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "cut")
    return both.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<lo:long,hi:long>>")
