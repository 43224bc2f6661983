"""Byte-level BPE as recursive DuckDB queries: one per batch of words that a Python worker hasn't met before.

A text is cut by the public pattern. Each new word becomes rows of (word, position, token); a step joins neighbours
with the merge table and contracts each word's leftmost pair of least rank, until no word has one. Ordered
aggregation puts the tokens together: ids joined by commas, and the bytes that they stand for.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

#: Longer words, in bytes, are contracted by a heap in Python: steps times rows would grow with the square.
LONGEST = 96
#: Words of a query, and words that a worker remembers.
BATCH, MOST = 20_000, 700_000

#: A row is a token and the one after it: a at pos, b at next, rank of the pair they make (null: none).
STEPS = """
WITH RECURSIVE t(w, pos, next, a, b, rank, step) AS (
    SELECT w, pos, pos + 1, a, b, m.rank, 0 FROM start LEFT JOIN merges m USING (a, b)
  UNION ALL
    (WITH best AS (SELECT w, min(rank * 16384 + pos * 128 + next) AS best FROM t WHERE rank IS NOT NULL GROUP BY w),
          cut AS (SELECT w, best // 16384 AS c, best // 128 % 128 AS spot, best % 128 AS gone FROM best),
          moved AS (SELECT w, CASE WHEN pos = gone THEN spot ELSE pos END AS pos, next, CASE WHEN pos = gone THEN c ELSE a END AS a,
                           CASE WHEN next = spot THEN c ELSE b END AS b, rank, pos = gone OR next = spot AS changed, step + 1 AS step
                    FROM t JOIN cut USING (w) WHERE pos <> spot)
     SELECT w, pos, next, a, b, CASE WHEN changed THEN m.rank ELSE moved.rank END, step FROM moved LEFT JOIN merges m USING (a, b))
), last AS (SELECT w, max(step) AS step FROM t GROUP BY w),
token AS (
    SELECT w, pos, a AS id FROM t JOIN last USING (w, step)
  UNION ALL
    SELECT w, max(next), arg_max(b, next) FROM t JOIN last USING (w, step) GROUP BY w
)
SELECT w, string_agg(id::VARCHAR || ' ' || hex, ',' ORDER BY pos) FROM token JOIN vocabulary USING (id) GROUP BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Words to ids joined by commas and to the bytes that these decode to, remembered for the worker's life."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.single = np.array([self.ranks[bytes([k])] for k in range(256)])
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        # Every way in which two tokens make a third.
        merges = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        made = pa.table({n: pa.array(c, pa.int64()) for n, c in zip("abc", zip(*merges, strict=True), strict=True)}).rename_columns(["a", "b", "rank"])
        words = pa.table({"id": pa.array(self.tokens.keys(), pa.int64()), "hex": [t.hex() for t in self.tokens.values()]})
        for name, rows in (("merges", made), ("vocabulary", words)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _by_steps(self, words: list[tuple[str, bytes]]) -> None:
        raw = np.frombuffer(b"".join(r for _, r in words), np.uint8)
        size = np.array([len(r) for _, r in words])
        w, pos = np.repeat(np.arange(len(words)), size), np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
        inner = np.flatnonzero(pos[1:])  # a word of two tokens or more has a pair; others never come here
        ids = self.single[raw]
        self.db.register("start", pa.table({"w": w[inner], "pos": pos[inner], "a": ids[inner], "b": ids[inner + 1]}))
        for w, joined in self.db.execute(STEPS).fetchall():
            parts = joined.replace(",", " ").split(" ")
            self._keep(words[w][0], ",".join(parts[::2]), bytes.fromhex("".join(parts[1::2])))
        self.db.unregister("start")

    def _by_heap(self, raw: bytes) -> list[int]:
        """The same contraction of one long word, in time n log n."""
        n = len(raw)
        part, after, before = [raw[k : k + 1] for k in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n and (rank := self.ranks.get(both := part[k] + part[after[k]])) is not None:
                heapq.heappush(heap, (rank, k, both))

        for k in range(n):
            offer(k)
        while heap:
            _, k, both = heapq.heappop(heap)
            if not part[k] or after[k] >= n or part[k] + part[after[k]] != both:
                continue
            gone = after[k]
            part[k], part[gone], after[k] = both, b"", after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [self.ranks[p] for p in part if p]

    def _keep(self, word: str, ids: str, raw: bytes) -> None:
        self.ids[word], self.raw[word] = ids, raw

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > MOST:
            self.ids.clear()
            self.raw.clear()
        steps = []
        for word in words.difference(self.ids):
            raw = word.encode("utf-8", "surrogatepass")
            if raw in self.ranks or len(raw) > LONGEST:
                ids = [self.ranks[raw]] if raw in self.ranks else self._by_heap(raw)
                self._keep(word, ",".join(map(str, ids)), b"".join(map(self.tokens.__getitem__, ids)))
            else:
                steps.append((word, raw))
        for k in range(0, len(steps), BATCH):
            self._by_steps(steps[k : k + BATCH])

    def encode(self, batch: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: the number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded bytes."""
        cut = list(map(self.pattern.findall, batch))
        self.learn({w for ws in cut for w in ws})
        for words in cut:
            ids = ",".join(map(self.ids.__getitem__, words)).encode()
            raw = hashlib.sha256(b"".join(map(self.raw.__getitem__, words)))
            yield ids.count(b",") + bool(ids), hashlib.sha256(ids).hexdigest(), raw.hexdigest()


_codecs: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """One for each path and Python worker."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array), decoded (binary). Texts and odd rows as in ``round_trip``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            cut = [c.pattern.findall(t) for t in b.column("text").to_pylist()]
            c.learn({w for ws in cut for w in ws})
            ids = [[int(i) for w in ws for i in c.ids[w].split(",")] for ws in cut]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([b"".join(c.raw[w] for w in ws) for ws in cut], pa.binary())], ["doc_id", "ids", "decoded"])

    small_batches(docs.sparkSession, 500)
    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty; an empty one has no ids, and the digests of nothing. Special tokens' strings are
    ordinary text. A word is cut into the least-rank pairs, leftmost first; a word that is a token is that token.
    Rows that repeat give the same digests; a null doc_id stays null; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            rows = list(c.encode(b.column("text").to_pylist()))
            n, ids, raw = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession, 500)
    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
