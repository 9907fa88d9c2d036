"""Problem 6: token ids of a whole corpus under a public byte-level BPE vocabulary.

Lookup has two tiers. A minimal perfect hash resolves pre-tokens that are vocabulary entries as a whole; misses are
merged with a heap over a linked list of bytes, so that even a pre-token of a million characters takes n log n steps.
Only distinct pre-tokens of a slice of documents are looked up; ids are then gathered with array arithmetic.

The table is built once on the driver and broadcast: its size is that of the vocabulary file, whatever the corpus.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.runtime import spread

#: Characters of text that are tokenized at a time.
SLICE_CHARS = 1 << 21
_MASK, _STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15


class PerfectHash:
    """A minimal perfect hash from byte strings to values, by hash and displace.

    Keys fall into buckets; each bucket, largest first, gets the first displacement that sends its keys to free slots of
    a table with exactly one slot a key. A bucket of one key stores its slot instead. A lookup compares the stored key,
    so strings outside the set are recognised.
    """

    def __init__(self, entries: dict[bytes, int]):
        n = len(entries)
        self.n, self.buckets = n, max(1, n // 4)
        self.move = np.zeros(self.buckets, np.int64)
        self.keys: list[bytes] = [b""] * n
        self.values = np.zeros(n, np.int32)
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in entries:
            h = xxhash.xxh3_64_intdigest(key)
            groups[h % self.buckets].append((h, key))
        taken, at = np.zeros(n, bool), 0
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if len(group) > 1:
                low = np.array([h >> 20 for h, _ in group], np.uint64)[:, None]
                step = np.array([((h >> 7) | 1) * _STEP & _MASK for h, _ in group], np.uint64)[:, None]
                first, width = 1, 32
                while True:  # displacements are tried in widening runs
                    slots = (low + step * np.arange(first, first + width, dtype=np.uint64)) % np.uint64(n)
                    good = ~taken[slots].any(axis=0)
                    if good.any():
                        order = np.sort(slots[:, good], axis=0)
                        good[good] = (order[1:] != order[:-1]).all(axis=0)
                    if good.any():
                        k = int(np.argmax(good))
                        self.move[b], chosen = first + k, slots[:, k].tolist()
                        break
                    first, width = first + width, min(width * 2, 8192)
            elif group:
                while taken[at]:
                    at += 1
                chosen = [at]
                self.move[b] = -1 - at
            else:
                continue
            for slot, (_, key) in zip(chosen, group, strict=True):
                taken[slot], self.keys[slot], self.values[slot] = True, key, entries[key]

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 20) + d * (((h >> 7) | 1) * _STEP & _MASK) & _MASK) % self.n

    def get(self, key: bytes) -> int | None:
        """The value of ``key``, or null if it isn't in the set."""
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = int(self.move[h % self.buckets])
        s = -1 - d if d < 0 else self._slot(h, d)
        return int(self.values[s]) if self.keys[s] == key else None


def merge(piece: bytes, byte_ids: list[int], ranks: dict[int, int]) -> list[int]:
    """The ids of one pre-token by lowest-rank merges. ``ranks``: left id << 32 | right id to the merged id, which orders merges."""
    ids = [byte_ids[b] for b in piece]
    n = len(ids)
    if n < 2:
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(new, k) for k in range(n - 1) if (new := ranks.get(ids[k] << 32 | ids[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        new, k = heapq.heappop(heap)
        r = after[k]
        if ids[k] < 0 or r >= n or ranks.get(ids[k] << 32 | ids[r]) != new:
            continue  # one of the two has been merged since
        ids[k], ids[r] = new, -1
        after[k] = nxt = after[r]
        if nxt < n:
            before[nxt] = k
            if (m := ranks.get(new << 32 | ids[nxt])) is not None:
                heapq.heappush(heap, (m, k))
        if (p := before[k]) >= 0 and (m := ranks.get(ids[p] << 32 | new)) is not None:
            heapq.heappush(heap, (m, p))
    return [x for x in ids if x >= 0]


def _unprintable() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(4)
def load(path: str) -> tuple[PerfectHash, list[int], dict[int, int]]:
    """The perfect hash of whole pre-tokens, the id of each byte, and the merge table, from a vocabulary file.

    An entry goes into the hash only if merging its bytes yields that entry, so both tiers agree on every string.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, shown = model["vocab"], _unprintable()
    byte_ids = [0] * 256
    for ch, b in shown.items():
        byte_ids[b] = vocab[ch]
    ranks: dict[int, int] = {}
    last = -1
    for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
        new = vocab[a + b]
        if new <= last:
            raise ValueError("the ids of merged entries must follow the order of merges")
        last = ranks[vocab[a] << 32 | vocab[b]] = new
    whole = {}
    for entry, k in vocab.items():
        if all(ch in shown for ch in entry):
            piece = bytes(shown[ch] for ch in entry)
            if merge(piece, byte_ids, ranks) == [k]:
                whole[piece] = k
    return PerfectHash(whole), byte_ids, ranks


def encode_texts(texts: list[str | None], table: tuple[PerfectHash, list[int], dict[int, int]], pattern: str) -> pa.Array:
    """``list<int32>`` ids of each text; null and empty texts give empty lists."""
    import regex

    whole, byte_ids, ranks = table
    split = regex.compile(pattern).findall
    pieces: list[str] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for k, text in enumerate(texts):
        if text:
            pieces += split(text)
        ends[k + 1] = len(pieces)
    coded = pa.array(pieces, pa.large_string()).dictionary_encode()
    ids: list[int] = []
    starts = [0]
    for piece in coded.dictionary.to_pylist():
        raw = piece.encode()
        found = whole.get(raw)
        if found is None:
            ids += merge(raw, byte_ids, ranks)
        else:
            ids.append(found)
        starts.append(len(ids))
    index, begin = coded.indices.to_numpy(), np.asarray(starts, np.int64)
    size = np.diff(begin)[index]
    stop = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(stop[-1]) + np.repeat(begin[index] - stop[:-1], size)
    values = np.asarray(ids, np.int32)[at] if len(at) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(stop[ends], pa.int32()), pa.array(values, pa.int32()))


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """``key, ids``: the token ids of every row's text, row for row, without special tokens.

    Null and empty texts give an empty list, white space is tokenized like other text, the spelling of a special token
    is ordinary text. Repeated keys stay repeated. Texts of any length are encoded whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(vocabulary))
    slim = df.select(F.col(key), F.col(text).alias("text"))
    schema = T.StructType([slim.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts, begin, chars = part.column(1).to_pylist(), 0, 0
            for k, t in enumerate(texts):
                chars += len(t or "")
                if chars > SLICE_CHARS or k == len(texts) - 1:
                    ids = encode_texts(texts[begin : k + 1], shared.value, pattern)
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(begin, k + 1 - begin), ids], names=[key, "ids"])
                    begin, chars = k + 1, 0

    return spread(slim).mapInArrow(run, schema)
