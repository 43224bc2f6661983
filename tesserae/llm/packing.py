"""Best-fit packing by a grouping genetic algorithm, on islands that send each other their best.

Pieces are dealt to districts of a bounded number of pieces. In each district several islands evolve a population of
packings; a child gets whole well-filled bins of one parent, loses the bins of the other that they clash with, and
best-fits the documents that this displaces. After each epoch the best packing of each island goes to the
next one. What the districts leave in badly filled bins is dealt again, to fewer districts.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import by_bytes, small_batches, texts, written

CAPACITY, SEPARATOR = 2048, 0
DISTRICT, ISLANDS, EPOCHS = 4096, 2, 2
POPULATION, CHILDREN = 5, 16
#: Bins under this share of the capacity are dealt again.
LOOSE = 0.995
ROUNDS = 3
#: What tells one piece from another; copy is a number of the row, as rows may share both others.
KEY = ["doc", "piece", "copy"]
NO_ID = -(2**63)
#: Bytes of texts that are encoded at once.
TEXTS = 1 << 20
#: No pair of tokens has this rank. Rank and place in a word share one number, so words of more bytes than places go another way.
_NO_RANK, _PLACES = 1 << 24, 64


class Merges:
    """The tokenizer's merges for many words at once: each step contracts every word's leftmost pair of least rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right, made = (np.array([ids[x] for x in part], np.int64) for part in (*zip(*pairs, strict=True), [a + b for a, b in pairs]))
        self.made = made.astype(np.int32)
        self.size = max(ids.values()) + 1
        # A table of ranks by a hash of the pair; the rank of an empty slot is the number of merges, whose key no pair has.
        self.none = len(pairs)
        self.key = np.append(left * self.size + right, -1)
        self.shift = np.uint64(64 - max(8, (4 * self.none).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), self.none, np.int32)
        rank, at = np.arange(self.none, dtype=np.int32), self._slot(self.key[:-1])
        while len(rank):
            free = self.slots[at] == self.none
            _, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.slots[at[chosen]] = rank[chosen]
            rest = np.setdiff1d(np.arange(len(rank)), chosen)
            rank, at = rank[rest], (at[rest] + 1) % len(self.slots)
        # Each byte as the tokenizer writes it, within a word and at its end.
        printed = {c.encode("utf-8"): ids[c] for c in ids if len(c) == 1}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.inner = np.array([printed[names[b].encode("utf-8")] for b in range(256)], np.int32)
        self.final = np.array([ids[names[b] + model["end_of_word_suffix"]] for b in range(256)], np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = self._slot(key)
        rank = self.slots[at]
        wrong = np.flatnonzero((self.key[rank] != key) & (rank != self.none))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.slots)
            rank[wrong] = self.slots[at[wrong]]
            wrong = wrong[(self.key[rank[wrong]] != key[wrong]) & (rank[wrong] != self.none)]
        rank[rank == self.none] = _NO_RANK
        return rank

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has. Each word has from one to ``_PLACES`` bytes."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(size) - size
        token = self.inner[raw]
        token[starts + size - 1] = self.final[raw[starts + size - 1]]
        place = (np.arange(len(raw)) - np.repeat(starts, size)).astype(np.int32)
        # What stands at a token is the score of the pair it begins.
        score = np.full(len(raw), _NO_RANK * _PLACES, np.int32)
        score[:-1] = self._rank(token[:-1], token[1:]) * _PLACES
        score[starts + size - 1] = _NO_RANK * _PLACES
        score += place
        word = np.arange(n)
        out = []
        while len(word):
            best = np.minimum.reduceat(score, starts)
            live = best < _NO_RANK * _PLACES
            if not live.all():
                going = np.repeat(live, size)
                out.append((word[~live], size[~live], token[~going]))
                word, size, best, token, score, place = word[live], size[live], best[live], token[going], score[going], place[going]
                if not len(word):
                    break
            at = np.flatnonzero(score == np.repeat(best, size))
            token[at] = self.made[best // _PLACES]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False  # taken into the token before it
            token, score, place = token[keep], score[keep], place[keep]
            now = at - np.arange(len(at))
            size = size - 1
            starts = np.cumsum(size) - size
            last = now == starts + size - 1
            score[now[last]] = _NO_RANK * _PLACES + place[now[last]]
            k = np.concatenate([now[~last], now[now > starts] - 1])
            score[k] = self._rank(token[k], token[k + 1]) * _PLACES + place[k]
        word, size, token = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(word)
        return token[_runs((np.cumsum(size) - size)[order], size[order])], size[order]


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of runs that begin at ``first`` and have ``size`` members, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Words:
    """Words met so far, each with its ids in one growing array."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.first, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, "<u4")
        self.used = 0

    def find(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 for one that isn't known."""
        return np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))

    def add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """New words, the ids of all of them, and how many each has."""
        n, more = len(self.at), len(words)
        while n + more > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.first[n : n + more] = self.used + np.cumsum(size) - size
        self.size[n : n + more] = size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.at.update(zip(words, range(n, n + more), strict=True))


class Encoder:
    """Ids of whole texts, word by word: the tokenizer drops white space and never joins words across it.

    Each distinct word of a batch is looked up once, and a text's ids are gathered from those of its words; a word that
    isn't known is put in lower case and cut by the tokenizer's own pattern, and its parts go through the merges.
    """

    #: The table of words has two generations of so many: a word of the older one moves up when it is met again.
    WORDS = 250_000
    #: A letter and a sign that can't go on with it: the tokenizer cuts here, so a blank changes no id, and words repeat more.
    CUT = r"([A-Za-z])([!-&(-/:-@])"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = Merges(path)
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.words, self.old = _Words(), _Words()

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        plain, parts, count, other, whole = [], [], [], [], []
        for w in words:
            low = w.lower()
            # Where str.lower, or the Unicode of another year, could differ from the tokenizer's own steps it takes the word.
            if not w.isascii() and ("Σ" in w or not w.isprintable() or not unicodedata.is_normalized("NFC", w)):
                whole.append(w)
            elif len(low) <= _PLACES // 4 and low.isalpha():  # letters alone are just one part
                plain.append((w, low.encode("utf-8")))
            else:
                cut = [p.encode("utf-8") for p in self.parts.findall(low)]
                if max(map(len, cut), default=0) > _PLACES:
                    whole.append(w)
                else:
                    other.append(w)
                    count.append(len(cut))
                    parts += cut
        self.words.add([w for w, _ in plain], *self.merges([low for _, low in plain]))
        ids, size = self.merges(parts)
        ends, stop = np.concatenate([[0], np.cumsum(size)]), np.cumsum(np.array(count, np.int64))
        self.words.add(other, ids, ends[stop] - ends[stop - np.array(count, np.int64)])
        for w in whole:
            ids = self._encode(w)
            self.words.add([w], ids, np.array([len(ids)]))

    def _known(self, words: list[str]) -> np.ndarray:
        if len(self.words.at) > self.WORDS:
            self.words, self.old = _Words(), self.words
        at = self.words.find(words)
        new = [words[i] for i in np.flatnonzero(at < 0).tolist()]
        if new:
            before = self.old.find(new)
            met = before[before >= 0]
            again = _runs(self.old.first[met], self.old.size[met])
            self.words.add([new[i] for i in np.flatnonzero(before >= 0).tolist()], self.old.ids[again], self.old.size[met])
            missing = [new[i] for i in np.flatnonzero(before < 0).tolist()]
            for i in range(0, len(missing), 50_000):
                self._learn(missing[i : i + 50_000])
            at[at < 0] = self.words.find(new)
        return at

    def batch(self, texts: pa.StringArray | list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text, the separator at its end."""
        column = texts if isinstance(texts, pa.StringArray) else pa.array(texts, pa.string())
        if not len(column):
            return []
        # Controls that only Arrow takes for white space: the tokenizer has such texts whole.
        odd = np.flatnonzero(pc.match_substring_regex(column, r"[\x1c-\x1f]").to_numpy(zero_copy_only=False)).tolist()
        alone = {i: self._encode(column[i].as_py()) for i in odd}
        if odd:
            column = pc.if_else(pc.is_in(pa.array(range(len(column))), pa.array(odd)), "", column)
        split = pc.utf8_split_whitespace(pc.replace_substring_regex(column, self.CUT, r"\1 \2"))
        coded = split.flatten().dictionary_encode()
        at = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        first, size = self.words.first[at], self.words.size[at]
        code = coded.indices.to_numpy()
        each = size[code]
        flat = self.words.ids[_runs(first[code], each)]
        ends = np.concatenate([[0], np.cumsum(each)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        # Behind the ids of each text comes the separator.
        flat = np.insert(flat, ends[1:], SEPARATOR)
        stop = (ends + np.arange(len(ends))).tolist()
        ids = [flat[i:j] for i, j in zip(stop[:-1], stop[1:], strict=True)]
        return [np.concatenate([alone[i], x]) if i in alone else x for i, x in enumerate(ids)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each path and Python worker, so that what it knows outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, cut where they are longer than ``capacity``."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in by_bytes(batches, TEXTS):
            rows = []
            for i, ids in zip(b.column("doc_id").to_pylist(), encoder.batch(b.column("text")), strict=True):
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    rows.append((i, k // capacity, k, len(part), zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            # A worker that is kept for later tasks, of other stages too, would hold the largest batch's memory.
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


# A packing is a list of bins, a bin a list of the places of pieces in the district's array of lengths.


def best_fit(bins: list[list[int]], items: list[int], lengths: list[int], capacity: int, as_given: bool = False) -> list[list[int]]:
    """``bins`` with ``items`` put, longest first or as given, where they leave the least room; new bins where none has room."""
    room = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in items if as_given else sorted(items, key=lambda i: (-lengths[i], i)):
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        if left > lengths[i]:
            insort(room, (left - lengths[i], k))
    return bins


def cost(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Bins, then less the sum of squared fills, so that of equal counts the one with emptier leftovers wins."""
    return len(bins), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(one: list[list[int]], other: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Whole well-filled bins of ``other`` go into ``one``; bins they clash with go, and their pieces are best-fitted."""
    fill = np.array([sum(lengths[i] for i in b) for b in other])
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    taken = rng.choice(good, max(1, len(good) // int(rng.integers(3, 9))), replace=False)
    injected = [list(other[k]) for k in taken]
    inside = {i for b in injected for i in b}
    kept = [list(b) for b in one if not inside.intersection(b)]
    loose = [i for b in one if inside.intersection(b) for i in b if i not in inside]
    # The worst bins are opened too, and one at random, so that displaced pieces find new partners.
    kept.sort(key=lambda b: -sum(lengths[i] for i in b))
    opened = max(1, len(kept) // 20)
    loose += [i for b in kept[len(kept) - opened :] for i in b]
    kept = kept[: len(kept) - opened]
    if kept:
        loose += kept.pop(int(rng.integers(len(kept))))
    if rng.random() < 0.5:
        loose = [loose[k] for k in rng.permutation(len(loose))]
        return best_fit(injected + kept, loose, lengths, capacity, as_given=True)
    return best_fit(injected + kept, loose, lengths, capacity)


def evolve(lengths: list[int], seeds: list[list[list[int]]], capacity: int, seed: int, size: int = POPULATION, children: int = CHILDREN) -> list[list[int]]:
    """The best packing after ``children`` crossovers in a population that starts with ``seeds``; the first that can't be beaten."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // capacity)
    for s in seeds:
        if len(s) <= least:
            return s
    people = [[list(b) for b in s] for s in seeds]
    while len(people) < size:
        # Best fit of a random share as it comes, then of the rest longest first: good packings that aren't alike.
        order = rng.permutation(len(lengths)).tolist()
        share = int(len(order) * rng.random())
        people.append(best_fit(best_fit([], order[:share], lengths, capacity, as_given=True), order[share:], lengths, capacity))
    scored = sorted(((cost(p, lengths, capacity), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])
    for k in range(children):
        if scored[0][0][0] <= least or len(scored) < 2:
            break
        a, b = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[a][2], scored[b][2], lengths, capacity, rng)
        scored = sorted([*scored[:-1], (cost(child, lengths, capacity), size + k, child)], key=lambda x: x[:2]) if cost(child, lengths, capacity) <= scored[-1][0] else scored
    return scored[0][2]


def _numbered(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(numbers: np.ndarray) -> list[list[int]]:
    order = np.argsort(numbers, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1)] if len(order) else []


def _epoch(capacity: int, epoch: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What an island does in one epoch, starting from its last best and, if there is one, its guest."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", *KEY], ascending=[False, True, True, True], kind="stable")
        lengths = rows.length.tolist()
        island, place = int(rows.island.iloc[0]), int(rows.district.iloc[0])
        seeds = [_bins(rows[c].to_numpy(int)) for c in ("numbers", "guest") if c in rows and rows[c].notna().all()]
        # Every island starts from best-fit decreasing, so no packing is worse; what else it starts from is its own.
        seeds = seeds or [best_fit([], list(range(len(lengths))), lengths, capacity)]
        best = evolve(lengths, seeds, capacity, place * 1009 + island * 31 + epoch)
        return rows.assign(numbers=_numbered(best, len(rows)))[[*KEY, "length", "district", "numbers", "island"]]

    return step


def pack(items: DataFrame, capacity: int = CAPACITY, district: int = DISTRICT) -> DataFrame:
    """KEY, length -> the same with bin: one packing of each district of some ``district`` pieces.

    bin holds the place of the district times 2**24, plus a number in it.
    """
    n = items.count()
    districts = max(1, -(-n // district))
    # A district is a hash of the key: about as many pieces in each, and the same pieces whenever a task runs anew.
    dealt = items.select(*KEY, "length", F.pmod(F.xxhash64(*KEY), F.lit(districts)).alias("district"))
    state = dealt.withColumn("numbers", F.lit(None).cast("int")).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    schema = "doc long, piece int, copy long, length long, district long, numbers int, island int"
    for epoch in range(EPOCHS):
        if epoch:
            # The elite of each island moves on to the next: the same pieces, numbered as the neighbour packed them.
            guest = state.select(*KEY, "district", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("numbers").alias("guest"))
            state = state.join(guest, ["district", "island", *KEY])
        state = written(state.groupBy("district", "island").applyInPandas(_epoch(capacity, epoch), schema))
    fill = state.groupBy("district", "island", "numbers").agg(F.sum("length").alias("s"))
    square = F.col("s") / capacity * F.col("s") / capacity
    score = fill.groupBy("district", "island").agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("q"))
    best = score.groupBy("district").agg(F.min_by("island", F.struct("n", -F.col("q"), "island")).alias("island"))
    return state.join(best, ["district", "island"], "left_semi").select(*KEY, "length", (F.col("district") * 2**24 + F.col("numbers")).alias("bin"))


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, district: int = DISTRICT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one and has the separator alone. Rows that share a doc_id, whole copies too, get places
    of their own, however many there are. Null ids are packed as any other, and other columns of ``docs`` aren't looked at.
    No rows give no rows. Only texts of more than ``capacity`` ids are cut.
    """
    rows = pieces(docs, path, capacity).withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    rows = written(rows.withColumn("copy", F.monotonically_increasing_id()))  # fixed once the table is there

    full = rows.where(F.col("length") >= capacity)
    shares = max(1, full.count() // 100_000)
    full = full.select(*KEY, F.pmod(F.xxhash64(*KEY), F.lit(shares)).alias("share"))
    alone = F.lit(ROUNDS * 2**58) + F.col("share") * 2**24 + F.row_number().over(Window.partitionBy("share").orderBy(*KEY))
    placed = full.select(*KEY, alone.alias("bin"))

    left = rows.where(F.col("length") < capacity).select(*KEY, "length")
    for k in range(ROUNDS):
        got = written(pack(left, capacity, district).withColumn("bin", F.lit(k * 2**58) + F.col("bin")))
        stay = got
        if k < ROUNDS - 1 and left.count() > district:
            loose = got.groupBy("bin").agg(F.sum("length").alias("s")).where(F.col("s") < LOOSE * capacity).select("bin")
            stay = got.join(loose, "bin", "left_anti")
            left = written(got.join(loose, "bin", "left_semi").select(*KEY, "length"))
        placed = placed.unionByName(stay.select(*KEY, "bin"))
        if stay is got:
            break

    before = Window.partitionBy("bin").orderBy(F.desc("length"), *KEY).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(placed, KEY).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
