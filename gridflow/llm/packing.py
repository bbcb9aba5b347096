"""Packing of documents into fixed windows by minimum bin slack.

A document's ids are cut into full windows and one remainder.  Full windows are sequences of their own.  What is
packed is the histogram of remainder lengths, at most `window` - 1 numbers at any corpus size: each round takes the
longest remainder left and picks, by a bitset subset-sum programme over the multiset of lengths left, the companions
that fill the window closest to its capacity.  A choice is repeated as often as its lengths allow, so that there are
at most as many choices as lengths.  The table of choices is bounded by the window alone (its proof is in `choose`)
and is joined back by (length, rank of the piece among pieces of its length).

Ranks come from counts per (length, bucket) and a running sum over them, so that one frequent length is never
gathered in one task.

Defined results: a null text is empty; an empty text has only the end id; repeated rows are packed each for itself;
an empty table gives no pieces; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_chunks, materialise, parts

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
TOKENIZER = "word_bpe_49k.json"


#: A text with none of these needs no composition, and lower-casing it is the same in every library.
ODD = r"[^\t\n\r\x20-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]|<\|"
#: The vocabulary's own split, for lower-cased texts without those.
SPLIT = r"('s|'t|'re|'ve|'m|'ll|'d|[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+|[0-9]|[^\t\n\r\x20a-z0-9\x{df}-\x{f6}\x{f8}-\x{ff}]+)"


def gather(flat: np.ndarray, bounds: np.ndarray, code: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items code[i] of a ragged array in turn; the bounds are of groups of `per` items each."""
    n = np.diff(bounds)[code]
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(bounds[:-1][code] - ends[:-1], n) + np.arange(ends[-1])], ends[np.concatenate([[0], np.cumsum(per)])]


class WordEncoder:
    """Ids of texts by a vocabulary that drops white space and splits texts into words before any merge.

    A text's ids are those of its words in turn, so each distinct word of a chunk goes to the tokenizer's model once.
    A text with unusual characters goes through the whole tokenizer.  The cache is bounded; what falls out is encoded
    again.
    """

    MOST = 200_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in (*range(0x21, 0x7F), *range(0xC0, 0x100))}
        self.words = {"": b""}

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, as native unsigned 32-bit ones."""
        if len(self.words) > self.MOST:
            self.words = {"": b""}
        known, model, letters = self.words, self.tokenizer.model, self.bytes
        out = [known.get(w) for w in words]
        for i, found in enumerate(out):
            if found is None:
                w = words[i]
                ids = [t.id for t in model.tokenize(w if w.isascii() else w.translate(letters))]
                out[i] = known[w] = array("I", ids).tobytes()
        return out

    def texts(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column; null is empty."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        odd = pc.match_substring_regex(column, ODD).to_numpy(zero_copy_only=False)
        whole = iter(self.tokenizer.encode_batch_fast(column.filter(pa.array(odd)).to_pylist(), add_special_tokens=False))
        lists = pc.ascii_split_whitespace(column.filter(pa.array(~odd)))
        coded = lists.flatten().dictionary_encode()
        inner = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), SPLIT, r"\1 "))
        parts_ = inner.flatten().dictionary_encode()
        own = self.encode(parts_.dictionary.to_pylist())
        flat, bounds = np.frombuffer(b"".join(own), np.uint32), np.cumsum([0, *map(len, own)]) // 4
        flat, bounds = gather(flat, bounds, parts_.indices.to_numpy(), pc.list_value_length(inner).to_numpy())
        ids, ends = gather(flat, bounds, coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy())
        plain = iter(np.split(ids, ends[1:-1]) if len(ends) > 1 else [])
        return [np.array(next(whole).ids, np.uint32) if x else next(plain) for x in odd]


@lru_cache(maxsize=4)
def encoder_of(path: str) -> WordEncoder:
    """One encoder for each vocabulary in a Python worker, so that its cache serves later tasks."""
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Every document's ids cut into windows and a remainder: one row per piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in arrow_chunks(batches, 4_000_000):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.texts(batch.column("text")), strict=True):
                own, n = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes(), len(ids)
                rows += [(doc, s, min(window, n + 1 - s), zlib.crc32(own[4 * s : 4 * (s + window)]), n + 1) for s in range(0, n + 1, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset out of `counts` whose sum is closest to `room` from below.

    Bit s of `reach` is set if a sum s can be had.  Lengths go in descending; the copies of a length are added in
    powers of two.  Walking the steps backwards gives how many copies of each length the best sum takes.
    """
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (k * length)) & full
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= k * length
            out[length] = out.get(length, 0) + k
    return out


def choose(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank, copies, first sequence, offset) that place every remainder.

    A choice is repeated until a length of it runs out, so there are at most `window` choices; the distinct lengths
    of one add up to `window` at most, so they number under sqrt(2 * window).  The table has under
    window * sqrt(2 * window) rows (131,072 for 2,048), whatever the corpus.
    """
    counts, used, rows, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while counts:
        top = max(counts)
        own = {k: v for k, v in counts.items() if k != top} | ({top: counts[top] - 1} if counts[top] > 1 else {})
        choice = fill(own, window - top)
        choice[top] = choice.get(top, 0) + 1
        times, offset = min(counts[x] // k for x, k in choice.items()), 0
        for length, k in sorted(choice.items(), reverse=True):
            rows.append((length, used[length], used[length] + k * times - 1, k, sequence, offset))
            offset += k * length
            used[length] += k * times
            counts[length] -= k * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return rows


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, path, window, end_id), "pieces")
    buckets = max(64, parts(spark))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    each = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = each.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    table = spark.createDataFrame(choose(histogram, window) or [(0, 0, 0, 1, 0, 0)], "length int, low long, high long, copies long, base long, shift long")
    near = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("own", F.row_number().over(near) - 1).join(before.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))
    placed = ranked.join(F.broadcast(table), "length").where("rank between low and high")  # table: bounded by the window, see choose()
    return placed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        F.expr("base + (rank - low) div copies").alias("sequence_id"),
        F.expr("shift + ((rank - low) % copies) * length").alias("offset"),
    )
