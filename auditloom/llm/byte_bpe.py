"""Operator 7: byte-level BPE encoding and decoding by given merge ranks.

A text is cut into pre-tokens by a pattern. First tier: a minimal perfect hash over the vocabulary, looked up for
all distinct pre-tokens of a batch at once, with the key compared byte by byte. Second tier, for the misses: pairs
of neighbours in a linked list of bytes wait in a heap by (rank, position); the lowest is merged until none is left.
Null and empty texts give no ids. Encoding is lossless: decoding returns the bytes of the text.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

#: Bytes of misses of a generation whose merges a worker keeps; it keeps two generations. An entry counts with so many bytes besides its piece and ids.
KEPT_BYTES, ENTRY_BYTES = 48 << 20, 180
#: Texts are solved in groups of so many characters, which bounds a worker's memory.
GROUP_CHARS = 1_500_000


class MinimalPerfectHash:
    """Distinct keys to 0..n-1 without gaps. Keys that meet no other in a level's table stay there, the rest go a level down."""

    def __init__(self, keys: list[bytes], spread: float = 1.5):
        hashes = self.hashes(keys)
        if len(np.unique(hashes)) != len(keys):
            raise ValueError("keys aren't distinct")
        self.tables: list[np.ndarray] = []
        placed = 0
        while len(hashes):
            m = int(len(hashes) * spread) + 1
            at = self._at(hashes, len(self.tables), m)
            alone = np.bincount(at, minlength=m)[at] == 1
            slots = np.full(m, -1, np.int64)
            slots[np.sort(at[alone])] = np.arange(placed, placed + alone.sum())
            placed += int(alone.sum())
            self.tables.append(slots)
            hashes = hashes[~alone]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    @staticmethod
    def _at(hashes: np.ndarray, level: int, m: int) -> np.ndarray:
        x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 2**64 - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(m)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """For a key its number, for another string any number or -1."""
        hashes = self.hashes(keys)
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, table_ in enumerate(self.tables):
            got = table_[self._at(hashes[rest], level, len(table_))]
            out[rest] = got
            rest = rest[got < 0]
        return out


def _for_ascii(pattern: str) -> str:
    """The pattern with letter and number classes as ASCII ranges."""
    out, inside = [], False
    for part in re.split(r"(\\p\{[LN]\}|\\.|\[|\])", pattern):
        inside = part == "[" or inside and part != "]"
        ranges = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}.get(part)
        out.append(part if ranges is None else ranges if inside else f"[{ranges}]")
    return "".join(out)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        #: The same pattern over ASCII texts, for the quicker standard matcher.
        self.split_ascii = re.compile(_for_ascii(pattern), re.ASCII).findall
        keys = list(ranks)
        self.hash = MinimalPerfectHash(keys)
        self.keys: list[bytes] = [b""] * len(keys)
        self.packed: list[bytes] = [b""] * len(keys)
        for key, slot in zip(keys, self.hash.slots(keys).tolist(), strict=True):
            self.keys[slot], self.packed[slot] = key, ranks[key].to_bytes(4, "little")
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        n = max(ranks.values()) + 1
        pairs = [(ranks[k[:i]], ranks[k[i:]], r) for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]
        #: For an id what tells the id that it joins to with one on its right, or on its left.
        self.to_right = self._joining(n, ((a, b, r) for a, b, r in pairs))
        self.to_left = self._joining(n, ((b, a, r) for a, b, r in pairs))
        #: The same for two bytes.
        self.byte_rows = [[self.to_right[a](b) for b in self.byte_ids] for a in self.byte_ids]
        self.bytes_of = {i: k for k, i in ranks.items()}
        #: Merged misses of late, and those of the generation before.
        self.misses: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept = 0

    @staticmethod
    def _joining(n: int, pairs: Iterable[tuple[int, int, int]]) -> list[Callable[[int], int | None]]:
        found: dict[int, dict[int, int]] = {}
        for a, b, rank in pairs:
            found.setdefault(a, {})[b] = rank
        nothing: dict[int, int] = {}
        return [found.get(i, nothing).get for i in range(n)]

    def merge(self, piece: bytes) -> bytes:
        """The packed ids of a piece that isn't in the vocabulary as a whole."""
        to_right, to_left, rows, n, bits = self.to_right, self.to_left, self.byte_rows, len(piece), len(piece).bit_length()
        low = (1 << bits) - 1
        # the last position, also met as -1, stands before the first id and after the last: no pair joins with it
        ids = [*map(self.byte_ids.__getitem__, piece), -1]
        waits = [rows[a][b] for a, b in zip(piece, piece[1:], strict=False)]  # rank of the pair that starts here
        heap = [r << bits | i for i, r in enumerate(waits) if r is not None]
        waits += (None, None)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heapify(heap)
        while heap:
            i, rank = heap[0] & low, heap[0] >> bits
            if waits[i] != rank:
                heappop(heap)  # one of the two has been merged meanwhile
                continue
            j = after[i]
            after[i] = k = after[j]
            before[k] = i
            ids[i], ids[j], waits[j] = rank, -1, None
            waits[i] = right = to_right[rank](ids[k])
            h = before[i]
            waits[h] = left = to_left[rank](ids[h])
            if right is not None:
                heapreplace(heap, right << bits | i)
                if left is not None:
                    heappush(heap, left << bits | h)
            elif left is not None:
                heapreplace(heap, left << bits | h)
            else:
                heappop(heap)
        return array("I", [i for i in ids if i >= 0]).tobytes()

    def merged(self, piece: str, raw: bytes) -> bytes:
        """As merge, of a piece that may have come before. Misses that aren't asked for again while KEPT_BYTES of others are go."""
        ids = self.misses.get(piece)
        if ids is None:
            ids = self.older.pop(piece, None)
            if ids is None:
                ids = self.merge(raw)
            self.kept += ENTRY_BYTES + len(raw) + len(ids)
            if self.kept > KEPT_BYTES:
                self.older, self.misses, self.kept = self.misses, {}, 0
            self.misses[piece] = ids
        return ids

    def packed_ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.split_ascii(t) if t.isascii() else self.split(t) for t in texts]
        found: dict[str, bytes] = {}
        pieces = list(set().union(*cut))
        as_bytes = [p.encode() for p in pieces]
        for piece, raw, slot in zip(pieces, as_bytes, self.hash.slots(as_bytes).tolist(), strict=True):
            found[piece] = self.packed[slot] if slot >= 0 and self.keys[slot] == raw else self.merged(piece, raw)
        return [b"".join(map(found.__getitem__, c)) for c in cut]

    def decoded(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@functools.lru_cache(2)
def _coder(ranks_file: str, pattern: str) -> ByteBpe:
    with open(ranks_file, "rb") as f:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def _encoded(coder: ByteBpe, texts: pa.Array) -> Iterator[bytes]:
    group, chars = [], 0
    for t in texts:
        group.append(t.as_py() or "")
        chars += len(group[-1])
        if chars > GROUP_CHARS:
            yield from coder.packed_ids(group)
            group, chars = [], 0
    yield from coder.packed_ids(group)


def encoded(text: Column, ranks_file: str, pattern: str) -> Column:
    """BINARY: the ids of a text as little-endian unsigned 32-bit integers; empty for null."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(_encoded(_coder(ranks_file, pattern), texts), pa.binary())

    return encode(text)


def round_trip(df: DataFrame, ranks_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds token_ids (packed), n_tokens and decoded, the bytes that the ids stand for; such columns of df are replaced.

    As encode_documents and decode_documents, but by one Python worker a task, which holds one coder."""
    found = "__round_trip"

    @F.arrow_udf("ids binary, decoded binary")
    def both(texts: pa.Array) -> pa.Array:
        coder = _coder(ranks_file, pattern)
        ids = list(_encoded(coder, texts))
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(coder.decoded, ids), pa.binary())], ["ids", "decoded"])

    met = small_batches(df).withColumn(found, both(F.col(text)))
    return met.withColumns({"token_ids": F.col(found)["ids"], "n_tokens": F.expr(f"octet_length({found}.ids) div 4").cast("long"), "decoded": F.col(found)["decoded"]}).drop(found)


def decode_documents(df: DataFrame, ranks_file: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that packed ids stand for (empty for null); such a column of df is replaced."""
    df = small_batches(df).drop(out)
    at = df.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_file, pattern)
        for batch in batches:
            texts = pa.array([coder.decoded(r.as_py() or b"") for r in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, out])

    return df.mapInArrow(decode, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def encode_documents(df: DataFrame, ranks_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds token_ids (packed) and n_tokens; such columns of df are replaced."""
    return small_batches(df).withColumn("token_ids", encoded(F.col(text), ranks_file, pattern)).withColumn("n_tokens", F.expr("octet_length(token_ids) div 4").cast("long"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    args = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), *args)
    return found.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
