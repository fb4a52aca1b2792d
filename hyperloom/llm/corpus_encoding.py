"""Problem 6: encoding of the whole corpus with a public tokenizer.

Method: texts are split into pre-tokens by the tokenizer's public pattern inside the JVM. Encoding then is a two-tier
lookup per Arrow batch: the distinct pre-tokens of a batch are looked up in a minimal perfect hash of the vocabulary,
which resolves those that are whole vocabulary entries; the others are merged by rank with a heap over linked bytes.
Special tokens are not known to the encoder, so strings that look like them are plain text.

Defined results: null and empty texts give an empty list; every text is encoded whole, whatever its length; repeated
rows give a row each; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.dist import read_table, spread

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("HYPERLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public pattern of byte_bpe_50k, in Java's syntax (white space by its Unicode property).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
#: Texts that one pass of the lookup takes together, by their pre-tokens.
PASS_TOKENS = 200_000
#: Merged pre-tokens that a task remembers.
REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: base64 of the token's bytes and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_WORD = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings by displacement: as many slots as keys, two array reads a lookup."""

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != n:
            raise ValueError("keys repeat or their hashes collide")
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for k, h in enumerate(hashes):
            members[(h >> 32) % self.buckets].append(k)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.slot_key = np.full(n, -1, dtype=np.int64)
        taken = bytearray(n)
        for b in sorted((b for b in range(self.buckets) if len(members[b]) > 1), key=lambda b: (-len(members[b]), b)):
            own, d, slots = [hashes[k] for k in members[b]], 0, [0]
            while len(set(slots)) < len(own) or any(map(taken.__getitem__, slots)):
                d += 1
                by = d * 0x9E3779B97F4A7C15 & _WORD
                slots = [((x := (h ^ by) * 0xBF58476D1CE4E5B9 & _WORD) ^ x >> 31) % n for h in own]
            self.shift[b] = d
            for k, slot in zip(members[b], slots):
                taken[slot], self.slot_key[slot] = 1, k
        # A key alone in its bucket takes any free slot: its bucket stores the slot itself.
        free = (slot for slot in range(n) if not taken[slot])
        for b in range(self.buckets):
            if len(members[b]) == 1:
                slot = next(free)
                self.shift[b], self.slot_key[slot] = -slot - 1, members[b][0]

    def _place(self, h: np.ndarray, d: np.ndarray | np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
        return (x % np.uint64(self.n)).astype(np.int64)

    def index(self, h: np.ndarray) -> np.ndarray:
        """For hashes of keys, the key's number; for other hashes the number of some key."""
        d = self.shift[((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(d < 0, -d - 1, self._place(h, np.maximum(d, 0).astype(np.uint64)))
        return self.slot_key[slots]


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one pre-token: a heap of candidate pairs over a linked list, lowest rank first, then leftmost."""
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        left = parts[i]
        if left is None or (j := after[i]) == n or ranks.get(left + parts[j]) != r:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j] = left + parts[j], None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (s := ranks.get(parts[i] + parts[k])) is not None:
                heapq.heappush(heap, (s, i))
        if (h := before[i]) >= 0 and (s := ranks.get(parts[h] + parts[i])) is not None:
            heapq.heappush(heap, (s, h))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """The vocabulary with its perfect hash; its state is bounded by the vocabulary, so it can be broadcast."""

    def __init__(self, ranks: dict[bytes, int], tables: dict | None = None) -> None:
        self.ranks = ranks
        self.keys = list(ranks)
        self.ids = np.array([ranks[k] for k in self.keys], dtype=np.int64)
        if tables:
            self.hash = PerfectHash.__new__(PerfectHash)
            self.hash.__dict__.update(tables)
        else:
            self.hash = PerfectHash(self.keys)

    def state(self) -> tuple[dict[bytes, int], dict]:
        """Plain values that make the same encoder again."""
        return self.ranks, self.hash.__dict__

    def lookup(self, words: list[bytes], known: dict[bytes, list[int]]) -> list[list[int]]:
        """Ids of each pre-token; known keeps the merged ones."""
        if not words:
            return []
        at = self.hash.index(np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64))
        out = []
        for w, k in zip(words, at.tolist()):
            if self.keys[k] == w:
                out.append([int(self.ids[k])])
                continue
            ids = known.get(w)
            if ids is None:
                ids = merge_bytes(w, self.ranks)
                if len(w) < 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return out


def _passes(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about PASS_TOKENS pre-tokens each."""
    col = batch.column(column)
    ends = np.asarray(col.offsets)[1:] - np.asarray(col.offsets)[0]
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PASS_TOKENS, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _ids_of(part: pa.RecordBatch, encoder: Encoder, known: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and starts of the distinct pre-tokens, and of each pre-token its distinct number; offsets of the rows."""
    col = part.column(1)
    offsets = np.asarray(col.offsets) - np.asarray(col.offsets)[0]
    words = col.flatten().cast(pa.binary()).dictionary_encode()
    each = encoder.lookup(words.dictionary.to_pylist(), known)
    sizes = np.array([len(x) for x in each], dtype=np.int64)
    flat = np.array([i for x in each for i in x], dtype=np.int32)
    return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.asarray(words.indices, dtype=np.int64), offsets


def _encode(batches: Iterator[pa.RecordBatch], state: tuple) -> Iterator[pa.RecordBatch]:
    encoder, known = Encoder(*state), {}
    for batch in batches:
        for part in _passes(batch, 1):
            flat, starts, which, offsets = _ids_of(part, encoder, known)
            sizes = np.diff(starts)[which]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            # Position inside its pre-token of every id, added to where the pre-token's ids start.
            take = np.repeat(starts[:-1][which] - ends[:-1], sizes) + np.arange(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), pa.array(flat[take]))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])


def _measure(batches: Iterator[pa.RecordBatch], state: tuple) -> Iterator[pa.RecordBatch]:
    encoder, known = Encoder(*state), {}
    for batch in batches:
        for part in _passes(batch, 1):
            _, starts, which, offsets = _ids_of(part, encoder, known)
            ends = np.concatenate([[0], np.cumsum(np.diff(starts)[which])])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends[offsets]), pa.int64())], names=["id", "n"])


def pretokens(text: Column) -> Column:
    """The pre-tokens of a text in order; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


@lru_cache(maxsize=4)
def _state(path: str) -> tuple[dict[bytes, int], dict]:
    return Encoder(read_ranks(path)).state()


def _held(spark, name: str, folder: str | None):
    return spark.sparkContext.broadcast(_state(os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")))


def encode(texts: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, ids) of every row of ``texts`` (id bigint, text)."""
    held = _held(texts.sparkSession, name, folder)
    return spread(texts.select("id", "text"), "id").select("id", pretokens(F.col("text")).alias("w")).mapInArrow(lambda it: _encode(it, held.value), "id long, ids array<int>")


def token_counts(texts: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, n) of every row of ``texts`` (id bigint, text): the number of its tokens."""
    held = _held(texts.sparkSession, name, folder)
    return spread(texts.select("id", "text"), "id").select("id", pretokens(F.col("text")).alias("w")).mapInArrow(lambda it: _measure(it, held.value), "id long, n long")


def documents(spark, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def p6_ids(spark, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p6_counts(spark, sf_dir: str) -> DataFrame:
    """Number of tokens of every document."""
    return token_counts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id").withColumnRenamed("n", "n_tokens")


QUERIES, SQL = {"p6_ids": p6_ids, "p6_counts": p6_counts}, {}
