"""Byte n-grams by blocks of documents, shared by the language-model operators.

A block is a bounded slice of a partition's documents, in one row: their words with single spaces, and one end mark
each.  A block lists its own distinct n-grams once, so a frequent n-gram is one row for each block and never one for
each place; counts of all blocks meet in joins on the n-gram, and what a block needs of them comes back to it by its
number.  All of it grows in proportion to the input.

An n-gram of order k is a long: the order in the highest byte, then its k bytes.  A document is preceded by `order` - 1
end marks, so every place has an n-gram of every order.

Blocks meet in packs: a block sorts its distinct entries by bucket, each pack holds those of one bucket as byte planes,
and a bucket's packs of all blocks are one group.  There is one bucket for so many bytes of text, counted, so a group
has a bounded size whatever the input.  What comes back to a block lies in the order of its own entries, which it makes
again, so no key travels twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_chunks

#: Bytes of text in a block.
BLOCK = 3_000_000
END = 10
ORDER_SHIFT = 56


def words_of(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and single spaces between their words; null is empty."""
    lower = pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    return pc.ascii_trim_whitespace(pc.replace_substring_regex(lower, "[\\x20\\x09-\\x0d]+", " "))


def blocks(docs: DataFrame, id_column: str = "doc_id", by: str | None = None, block: int = BLOCK, after: bytes = b"") -> DataFrame:
    """block, lang, doc_ids, hashes, payload, size: documents of one language (all, without `by`) in input order.

    hashes tell rows with one id apart, by their text.

    payload: the texts one after the other, an end mark after each; `after` goes between a text's last word and it.
    """
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(by), F.lit("und")).alias("lang") if by else F.lit("").alias("lang"), "text", F.xxhash64("text").alias("hash"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in _merged(batches, block):
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                texts = words_of(own.column("text"))
                payload = b"".join(t + after + b"\n" if t else b"\n" for t in texts.cast(pa.large_binary()).to_pylist())
                yield pa.RecordBatch.from_pydict({"block": [number], "lang": [lang], "doc_ids": [own.column("doc_id").to_pylist()], "hashes": [own.column("hash").to_pylist()], "payload": [payload], "size": [len(payload)]}, schema=SCHEMA)
                number += 1

    return picked.mapInArrow(cut, "block long, lang string, doc_ids array<long>, hashes array<long>, payload binary, size long")


SCHEMA = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("payload", pa.binary()), ("size", pa.int64())])


def _merged(batches: Iterator[pa.RecordBatch], weight: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `weight` bytes of text out of smaller and larger ones."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in arrow_chunks(batches, weight):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= weight:
            yield _one(held)
            held, size = [], 0
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(b.num_rows for b in held) else held[0]


def stream(payload: bytes, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The full-order codes of all places of a block, and the number of places of each document."""
    symbols = np.frombuffer(payload, np.uint8)
    ends = np.flatnonzero(symbols == END)
    n = np.diff(ends, prepend=-1)
    starts = ends - n + 1
    code = symbols.astype(np.int64)
    # distance to the document's start, as far as it matters
    for back in range(1, order):
        prior = np.full(len(symbols), END, np.int64)
        prior[back:] = symbols[:-back]
        for near in range(back):  # the first places look back beyond the start
            at = starts[n > near] + near
            prior[at] = END
        code |= prior << (8 * back)
    return code, n


def lower(codes: np.ndarray, k: int) -> np.ndarray:
    return codes & ((1 << (8 * k)) - 1)


def keys_of(codes: np.ndarray, k: int) -> np.ndarray:
    return codes | (k << ORDER_SHIFT)


def every_order(codes: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all orders and contexts of distinct full-order codes, and their counts (contexts alone: 0)."""
    keys, sums = [np.array([0], np.int64)], [np.zeros(1, np.int64)]
    for k in range(1, order + 1):
        own, at = np.unique(lower(codes, k), return_inverse=True)
        keys += [keys_of(own, k), keys_of(np.unique(own >> 8), k - 1)]
        sums += [np.bincount(at, counts, len(own)).astype(np.int64), np.zeros(len(keys[-1]), np.int64)]
    flat, at = np.unique(np.concatenate(keys), return_inverse=True)
    return flat, np.bincount(at, np.concatenate(sums), len(flat)).astype(np.int64)


def distinct_of_every_order(train: np.ndarray, rest: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys of all orders at the places of full-order codes, and how often each occurs in `train`."""
    own, times = np.unique(train, return_counts=True)
    codes = np.concatenate([own, np.setdiff1d(np.unique(rest), own, assume_unique=True)])
    counts = np.concatenate([times, np.zeros(len(codes) - len(own), np.int64)])
    at = np.argsort(codes)
    codes, counts = codes[at], counts[at]
    keys, sums = [keys_of(codes, order)], [counts]
    for k in range(order - 1, 0, -1):
        codes, at = np.unique(lower(codes, k), return_inverse=True)
        counts = np.bincount(at, counts, len(codes)).astype(np.int64)
        keys.append(keys_of(codes, k))
        sums.append(counts)
    return np.concatenate(keys[::-1]), np.concatenate(sums[::-1])  # longer n-grams have larger keys


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2**64 - 1 as compressed byte planes, those of high bytes that are all nought left out."""
    planes = np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = 8
    while width and not planes[width - 1].any():
        width -= 1
    return len(values).to_bytes(4, "little") + bytes([width]) + (zstandard.ZstdCompressor(level=1).compress(planes[:width].tobytes()) if width else b"")


def widen(data: bytes) -> np.ndarray:
    """The numbers of `squeeze`, as uint64."""
    n, width = int.from_bytes(data[:4], "little"), data[4]
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        raw = zstandard.ZstdDecompressor().decompress(data[5:], max_output_size=n * width)
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    k = keys.astype(np.uint64)
    return squeeze(np.diff(k, prepend=np.uint64(0)))


def widen_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(widen(data), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, one to one."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def place_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: ranges of hashes, so that ascending hashes are in ascending buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def dealt(places: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, entries) for ascending places; only buckets with entries."""
    cuts = np.flatnonzero(np.diff(places, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(places)], strict=True):
        yield int(places[a]), slice(a, b)


def order_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, ORDER_SHIFT)


def prefix_of(key: Column) -> Column:
    """Key of the context: the n-gram without its last byte."""
    k = order_of(key)
    return F.shiftright(key.bitwiseAND(F.lit((1 << ORDER_SHIFT) - 1)), 8).bitwiseOR((k - 1).cast("long") * F.lit(1 << ORDER_SHIFT))


def suffix_of(key: Column) -> Column:
    """Key of the n-gram without its first byte."""
    k = order_of(key)
    return F.pmod(key.bitwiseAND(F.lit((1 << ORDER_SHIFT) - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), (8 * (k - 1)).cast("int"))).bitwiseOR((k - 1).cast("long") * F.lit(1 << ORDER_SHIFT))


def probabilities(keys: np.ndarray, term: np.ndarray, gamma: np.ndarray, order: int) -> np.ndarray:
    """P(last byte | the rest) of every key: term + gamma(context) * P(suffix), from the shortest order on.

    An n-gram that training has not seen has term 0; an unseen context has gamma 1.
    """
    p = np.full(len(keys), 1 / 256)
    k_of = keys >> ORDER_SHIFT
    code = keys & ((1 << ORDER_SHIFT) - 1)
    for k in range(1, order + 1):
        at = np.flatnonzero(k_of == k)
        context = np.searchsorted(keys, keys_of(code[at] >> 8, k - 1))
        context[context == len(keys)] = 0
        known = keys[context] == keys_of(code[at] >> 8, k - 1)
        weight = np.where(known, gamma[context], 1.0)
        below = 1 / 256
        if k > 1:
            s = np.searchsorted(keys, keys_of(lower(code[at], k - 1), k - 1))
            s[s == len(keys)] = 0
            below = np.where(keys[s] == keys_of(lower(code[at], k - 1), k - 1), p[s], 1 / 256)
        p[at] = term[at] + weight * below
    return p
