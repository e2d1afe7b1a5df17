"""Packing of tokenised documents into fixed-length sequences, balanced by cost."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import pieces

SEQUENCE = 2048
END = 1
SHARD = 20_000  # documents packed together; bounds a task's memory, not the result
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The ids that the `tokenizers` file gives, made by its faster public twin.

    The `.tiktoken` file beside it holds the same vocabulary as ranks; the text of
    the special token gives its id, as `tokenizers` does by default.  The twin gives up
    on very long runs of white space; such a text goes to `tokenizers` itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as ranks:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks)}
        self.path, self.library = path, None
        self.own = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": 50256})

    def ids(self, text: str) -> list[int]:
        try:
            return self.own.encode(text, allowed_special="all")
        except ValueError:
            from tokenizers import Tokenizer

            self.library = self.library or Tokenizer.from_file(self.path)
            return self.library.encode(text, add_special_tokens=False).ids


def _tokenise(path: str, size: int):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in pieces(batches, "text"):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encoder.ids(text or ""), END], "<u4")
                whole = len(ids) // size * size
                for start in range(0, whole, size):
                    rows.append((doc, start, size, zlib.crc32(ids[start : start + size]), len(ids), None))
                if whole < len(ids):
                    rest = ids[whole:]
                    narrow = rest.astype("<u2") if rest.max() < 65536 else rest
                    rows.append((doc, whole, len(rest), zlib.crc32(rest), len(ids), narrow.tobytes()))
            types = (*[pa.int64()] * 5, pa.binary())
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )

    return tokenise


def cost(length: int, size: int = SEQUENCE) -> float:
    """Estimated work for a piece: linear layers, and attention within the piece."""
    return length + length * length / size


class _Open:
    """Sequences by free places; gives the cheapest one with at least so many.

    Each number of free places has a heap of (cost, sequence); a tree over these
    numbers holds the smallest of each stretch, so a search takes log(size) steps.
    """

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.width)]
        self.least = [(float("inf"), -1)] * (2 * self.width)

    def _renew(self, free: int) -> None:
        heap, node = self.heaps[free], self.width + free
        self.least[node] = heap[0] if heap else (float("inf"), -1)
        while node > 1:
            node //= 2
            self.least[node] = min(self.least[2 * node], self.least[2 * node + 1])

    def put(self, free: int, spent: float, k: int) -> None:
        if free:
            heapq.heappush(self.heaps[free], (spent, k))
            self._renew(free)

    def cheapest(self, room: int) -> tuple[float, int]:
        """The cheapest sequence with `room` free places (ties: the first), or -1."""
        best = (float("inf"), -1)
        low, high = self.width + room, 2 * self.width
        while low < high:
            if low & 1:
                best = min(best, self.least[low])
                low += 1
            low, high = low // 2, high // 2
        return best

    def take(self, free: int) -> None:
        """Forget the cheapest sequence of those with exactly `free` places."""
        heapq.heappop(self.heaps[free])
        self._renew(free)


def balance(lengths: list[int], size: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Pieces (document, first, last) of each sequence, for documents below `size` tokens.

    There are as many sequences as the tokens fill.  Documents in descending order
    of cost go to the cheapest sequence that can hold them whole.  Those that none
    can hold are cut at the end, again over the cheapest sequences with room, so
    only the last sequence stays short.
    """
    total = sum(lengths)
    n = -(-total // size)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    free = [size] * n
    if n:
        free[-1] = total - (n - 1) * size
    places, left = _Open(size), []
    for k in range(n):
        places.put(free[k], 0.0, k)

    def fill(k: int, spent: float, d: int, first: int, last: int) -> None:
        places.take(free[k])
        out[k].append((d, first, last))
        free[k] -= last - first
        places.put(free[k], spent + cost(last - first, size), k)

    for d in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        spent, k = places.cheapest(lengths[d])
        if k < 0:
            left.append(d)
        else:
            fill(k, spent, d, 0, lengths[d])
    for d in left:
        at = 0
        while at < lengths[d]:
            spent, k = places.cheapest(1)
            last = min(at + free[k], lengths[d])
            fill(k, spent, d, at, last)
            at = last
    return out


def _packer(size: int):
    """Packs one shard after another; rows come sorted by shard, remainders first."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    def packed(shard: int, rests: list[tuple]) -> list[tuple]:
        out = []
        for k, sequence in enumerate(balance([r[2] for r in rests], size)):
            offset = 0
            for d, first, last in sequence:
                doc, start, length, crc, tokens, ids = rests[d]
                if last - first < length:
                    width = len(ids) // length
                    part = np.frombuffer(ids, f"<u{width}")[first:last].astype("<u4")
                    crc = zlib.crc32(part)
                out.append((doc, start + first, last - first, crc, tokens, shard << 32 | k, offset))
                offset += last - first
        return out

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rests, used = None, [], 0
        for batch in batches:
            rows: list[tuple] = []
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", *names[:5], "ids")), strict=True):
                if own != shard:
                    if rests:
                        rows += packed(shard, rests)
                    shard, rests, used = own, [], 0
                if row[5] is None:
                    if rests:
                        made = packed(shard, rests)
                        rows += made
                        used = (made[-1][5] & 0xFFFFFFFF) + 1
                        rests = []
                    rows.append((*row[:5], shard << 32 | used, 0))
                    used += 1
                else:
                    rests.append(tuple(row))
            if rows:
                yield batch_of(rows)
        if rests:
            yield batch_of(packed(shard, rests))

    return pack


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, shard: int = SHARD) -> DataFrame:
    """Pieces of all documents in sequences of at most `size` tokens.

    Takes `doc_id`, `text`; gives doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  A document is its ids and then id 1.  Whole stretches of
    `size` ids are sequences of their own; the remainders of about `shard`
    documents are balanced together, by a hash of the id and the text, so that no
    task holds more than its shard.  A shard wastes less than one sequence.

    Null or empty text: one token, the end.  Rows that repeat an id are packed once
    per row; null ids are packed too.  An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    n = max(1, -(-docs.count() // shard))
    tokens = docs.mapInArrow(_tokenise(path or vocabulary(), size), f"{_PIECE}, ids binary")
    key = F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(n)).alias("shard")
    order = ["shard", F.col("ids").isNull(), "doc_id", "start", "ids_crc32"]
    dealt = tokens.select(key, "*").repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions(*order)
    return dealt.mapInArrow(_packer(size), f"{_PIECE}, sequence_id long, offset long")
