"""Byte-level BPE encoding and decoding as monoid tree reductions.

A text is encoded by halves.  Two levels of the same idea:

* Pieces.  The pattern that splits a text has no look-behind, and where a match ends
  depends on the match, one following character and at most three characters from its
  start.  So, when two halves are joined, pieces of the left half that end early enough
  before the seam stay; from the first unsure piece on the text is split again, over a
  window into the right half that doubles until a new boundary meets an old one.
  From equal positions on, equal text splits equally, so the rest of the right half stays.
* Tokens of a long piece.  Halves are encoded on their own; at the seam a window of
  tokens is merged again and doubles on a side until the token outside and the first
  token inside are compatible (encoding the two together gives back the two).  A token
  sequence all of whose neighbours are compatible is the encoding of its bytes,
  provided each token of the vocabulary encodes to itself; that is checked on loading.

Decoding concatenates byte strings up the same kind of tree.

Defined results: null text encodes as empty; empty text gives no tokens; special tokens
are never produced; rows are independent, so repeats and other columns need no care.
Each row is handled where it is read: no shuffle.  Memory: one Arrow batch, a few
rows of it as Python objects, and a piece cache of five dictionaries of ``CACHE_PIECES`` entries a worker.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopstream.llm.workers import lean

LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 16_384, 5, 4_096
CACHE_PIECES, CACHED_CHARS = 60_000, 64  # of each dictionary; a pipeline keeps its workers, and with them these
SHORT_BYTES, NO_RANK = 40, 1 << 60


class Codec:
    """Ranks of a vocabulary file and the splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        # ids of pieces, as bytes, and of two tokens side by side (see ``seam``); when the
        # younger dictionary is full it becomes the older one, so that what is met again stays
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.seams: dict[int, tuple[int, ...]] = {}
        self.older_seams: dict[int, tuple[int, ...]] = {}
        self.leaves: dict[bytes, tuple[int, ...]] = {}
        # the two tokens whose merge makes a token; none for single bytes
        self.halves: list[list[int]] = [[] for _ in self.bytes_of]
        self.reducible = True
        for token, made in ranks.items():
            if len(token) > 1:
                parts = self._merge_short(token, leave=2)
                self.halves[made] = parts
                self.reducible &= len(parts) == 2

    # ---- tokens of one piece

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost first, over the whole byte string at once."""
        if len(data) <= SHORT_BYTES:
            return self._merge_short(data)
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))          # a part starts at i and ends at end[i]
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= stop:
                continue
            j = end[i]
            if j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return out

    def _merge_short(self, data: bytes, leave: int = 1) -> list[int]:
        """As ``merge`` (until ``leave`` parts are left); scanning all neighbours is quicker for a few bytes."""
        rank = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        merged = [rank(data[i:i + 2], NO_RANK) for i in range(len(data) - 1)]  # of parts i and i + 1
        while len(merged) >= leave and (best := min(merged)) != NO_RANK:
            i = merged.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del merged[i]
            if i < len(merged):
                merged[i] = rank(parts[i] + parts[i + 1], NO_RANK)
            if i:
                merged[i - 1] = rank(parts[i - 1] + parts[i], NO_RANK)
        return [self.ranks[x] for x in parts]

    def seam(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of two tokens together; empty if they stay as they are."""
        known = self.seams.get(a << 32 | b)
        if known is None:
            known = self.older_seams.get(a << 32 | b)
            if known is None:
                known = () if self._stay_apart(a, b) else tuple(self.merge(self.bytes_of[a] + self.bytes_of[b]))
            if len(self.seams) >= CACHE_PIECES:
                self.seams, self.older_seams = {}, self.seams
            self.seams[a << 32 | b] = known
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        """No merge across the seam comes due while both of its sides exist.

        Walks back through the merges that made the two tokens, latest first.  The parts
        at the seam last until the first of them is merged with its other neighbour; of
        two merges of one rank the left one is done first.
        """
        until_a = until_b = NO_RANK
        text, halves, rank = self.bytes_of, self.halves, self.ranks.get
        while True:
            across = rank(text[a] + text[b], NO_RANK)
            if across < until_a and across <= until_b:
                return False
            if halves[b] and (b >= a or not halves[a]):
                until_b, b = b, halves[b][0]
            elif halves[a]:
                until_a, a = a, halves[a][1]
            else:
                return True

    def join_tokens(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right or not (inner := self.seam(left[-1], right[0])):
            return left + right
        i = j = 1
        while True:
            if i + j > 2:
                inner = self._known(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            fits_left = i >= len(left) or not self.seam(left[-i - 1], inner[0])
            fits_right = j >= len(right) or not self.seam(inner[-1], right[j])
            if fits_left and fits_right:
                return left[:-i] + inner + right[j:]
            if not fits_left:
                i = min(len(left), 2 * i)
            if not fits_right:
                j = min(len(right), 2 * j)

    def tokens(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= LEAF_BYTES:
            return self._known(data)
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        if not self.reducible:
            return self._known(data)
        half, known = len(data) // 2, self.leaves.get
        left, right = data[:half], data[half:]
        left, right = known(left) or self.tokens(left), known(right) or self.tokens(right)
        if self.seams.get(left[-1] << 32 | right[0]) == ():
            return left + right
        return self.join_tokens(left, right)

    def _known(self, data: bytes) -> tuple[int, ...]:
        """``merge``, remembering short byte strings."""
        if len(data) > SHORT_BYTES:
            return tuple(self.merge(data))
        out = self.leaves.get(data)
        if out is None:
            if len(self.leaves) >= CACHE_PIECES:
                self.leaves.clear()
            out = self.leaves[data] = tuple(self.merge(data))
        return out

    # ---- pieces of a text

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        keep, back = len(left), 0  # back: characters from the seam to the start of the first unsure piece
        while keep:
            size = len(left[keep - 1])
            if back >= 1 and back + size >= 3:
                break
            back += size
            keep -= 1
        seam = "".join(left[keep:])
        taken = 1
        while True:
            text = seam + "".join(right[:taken])
            all_in = taken >= len(right)
            old, k = len(seam), 0  # the next boundary of the right half, and how many of its pieces lie before
            new, at = self.split(text), 0
            for count, piece in enumerate(new):
                while k < taken and old < at:
                    old += len(right[k])
                    k += 1
                if at == old and at >= len(seam):
                    return left[:keep] + new[:count] + right[k:]
                if not all_in and max(at + len(piece) + 1, at + 3) > len(text):
                    break  # this piece could go on beyond the window
                at += len(piece)
            else:
                if all_in:
                    return left[:keep] + new
            taken = min(len(right), 2 * taken)

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.split(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece, remembered if it is short."""
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.older.get(piece)
            if ids is None:
                ids = array("i", self.tokens(piece.encode())).tobytes()
            if len(piece) <= CACHED_CHARS:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache, self.older = {}, self.cache
                self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        pieces = self.pieces(text)
        parts = list(map(self.cache.get, pieces))
        if None in parts:
            parts = [self._piece(piece) if ids is None else ids for piece, ids in zip(pieces, parts)]
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def _with_column(schema: T.StructType, name: str, kind: T.DataType, drop: str | None = None) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in (name, drop)] + [T.StructField(name, kind)])


def encode(df: DataFrame, path: str, pattern: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns but the text (and any old ``ids``), plus ``ids`` array<int>."""
    others = [c for c in df.columns if c not in (text, ids)]

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            found = [own.encode(t or "") for t in batch.column(text).to_pylist()]
            offsets = np.zeros(len(found) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            values = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[*others, ids])

    return df.select(*others, text).mapInArrow(lean(run), _with_column(df.schema, ids, T.ArrayType(T.IntegerType()), text))


def decode(df: DataFrame, path: str, pattern: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns plus ``decoded`` binary."""
    others = [c for c in df.columns if c != decoded]

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            lists = batch.column(ids)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            found = [own.decode(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(found, pa.binary())], names=[*others, decoded])

    return df.select(*others).mapInArrow(lean(run), _with_column(df.schema, decoded, T.BinaryType()))


def digest(tokens: DataFrame) -> DataFrame:
    """Per document: number of tokens and digests of the ids and of the decoded bytes."""
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    vocabulary = default_vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(decode(encode(docs, *vocabulary), *vocabulary))
