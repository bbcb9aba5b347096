"""Document fingerprints by a randomised edit embedding.

A text is walked by a random walk that all texts share: at step j it stands on a character c and writes it down, and
a random bit of (j, c) says whether it moves on.  Two texts that differ by k edits fall back into step soon after each
edit, so the written sequences differ in about k places: edit distance becomes Hamming distance.  Every text is walked
whole; those of a batch advance together, longest first, and the few longest go on alone.

A fingerprint samples the written sequence at `slots` places and keeps four hash bits of each.  The place of a slot is
chosen by jump hashing of (slot, length): uniform in the sequence, equal for equal lengths, and equal for lengths m < n
with chance m / n.  So the share of equal slots estimates the likeness of the sequences, whatever the two lengths.

Near texts: slots are sampled into bands, equal bands make candidates, and the Hamming distance of one bit of each slot
verifies them, with the bit-sliced comparison of the SimHash operator; classes follow the links.

Defined results: a null text is empty; an empty text has the all-zero fingerprint; equal texts have equal fingerprints;
rows with equal ids are ordered by their text (those of an id that is frequent in the table, by a hash of it first); null
ids come first; a table with one row is its own next row; an empty table gives none.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, parts
from .simhash import bucket_links, class_ids

SLOTS = 128
#: The walk's bits are made for so many steps at a time; with fewer walks than this under way each goes on by itself.
STEPS, FEW = 4096, 24
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Near texts: bands and slots of a band for candidates; at a likeness of 0.8 a pair shares a band with chance 0.992.
BANDS, BAND, LIKENESS = 16, 6, 0.8
#: Ranges of a hash that a frequent id is split into.
SPLIT = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def steps_of(n: np.ndarray) -> np.ndarray:
    """Steps of a walk over n characters: it moves on with chance 1/2, so these pass the end; it then starts over."""
    return (9 * n) // 4 + 64


@lru_cache(maxsize=64)
def bits_at(window: int) -> np.ndarray:
    """The walk's random bits by (step, character class), for the steps from window * STEPS on."""
    first = np.uint64(window * STEPS * 256) + np.uint64(0x9E3779B97F4A7C15)
    return (mix(np.arange(STEPS * 256, dtype=np.uint64) + first) >> np.uint64(63)).astype(np.uint8).reshape(STEPS, 256)


def moves() -> Callable[[int], np.ndarray]:
    """The walk's random bits by window of steps."""
    return bits_at


def jump(slots: int, length: np.ndarray) -> np.ndarray:
    """[texts, slots]: the place of each slot in sequences of these lengths (consistent jump hashing)."""
    key = np.broadcast_to(mix(np.arange(1, slots + 1, dtype=np.uint64)), (len(length), slots)).copy()
    at, to = np.full(key.shape, -1, np.int64), np.zeros(key.shape, np.int64)
    size = np.broadcast_to(length[:, None], key.shape)
    while (go := to < size).any():
        at[go] = to[go]
        key[go] = key[go] * np.uint64(2862933555777941757) + np.uint64(1)
        to[go] = ((at[go] + 1) * (float(1 << 31) / ((key[go] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
    return at


def embed(texts: list[str], table: Callable[[int], np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """uint8 [texts, slots]: four bits of the characters that the walks write at the slots' places."""
    out = np.zeros((len(texts), slots), np.uint8)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    full = np.flatnonzero(n)
    if not len(full):
        return out
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = ((points ^ (points >> 8)) & 255).astype(np.uint8)
    n = n[full]
    begin, steps = np.cumsum(n) - n, steps_of(n)
    step = jump(slots, steps)
    # longest texts first, so that those still walking are a prefix
    order = np.argsort(-steps, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    begin, size, steps = begin[order], n[order], steps[order]
    ask = np.argsort(step.ravel(), kind="stable")
    who, when = np.repeat(rank, slots)[ask], step.ravel()[ask]
    got = np.empty(len(ask), np.int64)
    pos, end = begin.copy(), begin + size
    done = 0  # asks answered
    for base in range(0, int(steps[0]), STEPS):
        bits = table(base // STEPS)
        last = min(base + STEPS, int(steps[0]))
        cut = done + np.searchsorted(when[done:], np.arange(base, last + 1))
        live = len(steps) - np.searchsorted(steps[::-1], np.arange(base, last), side="right")
        for j in range(base, last):
            k = live[j - base]
            if k <= FEW:
                break
            a, b = cut[j - base], cut[j - base + 1]
            if a < b:
                got[a:b] = pos[who[a:b]]
            p = pos[:k]
            p += bits[j - base].take(kind.take(p))
            np.copyto(p, begin[:k], where=p >= end[:k])
        else:
            j = last
        if j < last:  # the few longest, each through the rest of the window
            flat = bits.tobytes()
            for w in range(live[j - base]):
                asked = cut[j - base] + np.flatnonzero(who[cut[j - base] : cut[-1]] == w)
                start, stop = int(begin[w]), int(size[w])
                p = int(pos[w]) - start
                near = kind[start + p : min(start + stop, start + p + STEPS)].tobytes() + (kind[start : start + STEPS].tobytes() if p + STEPS >= stop else b"")
                trail, at = np.empty(min(last, int(steps[w])) - j, np.int64), p
                i, fresh = 0, stop <= STEPS
                for t in range(len(trail)):
                    trail[t] = at
                    if flat[(j - base + t) * 256 + near[i]]:
                        at += 1
                        i += 1
                        if at == stop:
                            at = 0
                            if fresh:  # a short text starts over from its own first character
                                near, i = kind[start : start + stop].tobytes(), 0
                pos[w] = start + at
                got[asked] = start + trail[when[asked] - j]
        done = int(cut[-1])
    sample = np.empty(len(ask), np.uint8)
    sample[ask] = (mix(points[got].astype(np.uint64) + np.uint64(1)) >> np.uint64(60)).astype(np.uint8)
    out[full] = sample.reshape(len(n), slots)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def to_hex(prints: np.ndarray) -> list[str]:
    packed = (prints[:, ::2] << 4) | prints[:, 1::2]
    return [row.tobytes().hex() for row in packed]


def fingerprints(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id and fp (binary, two slots a byte) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = moves()
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                prints = embed(["" if t is None else t for t in part["text"]], table, slots)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "fp": [bytes.fromhex(x) for x in to_hex(prints)]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp binary")


def near_radius(like: float, slots: int) -> int:
    """Bits of a sketch within which nearly all pairs are whose slots are equal with this chance: the mean and two standard deviations.

    Slots that differ in their four bits differ in one of them with chance 8 / 15.
    """
    p = (1 - like) * 8 / 15
    return int(slots * p + 2 * np.sqrt(slots * p * (1 - p)))


def sketch(prints: np.ndarray) -> np.ndarray:
    """One bit of each slot, packed."""
    return np.packbits(prints & 1, axis=1)


def near_table(own: DataFrame, like: float = LIKENESS, slots: int = SLOTS) -> DataFrame:
    """fp, component_id of every distinct fingerprint of `own` (doc_id, fp): the smallest doc_id reachable over texts about `like` alike.

    A node is a sketch.  Candidates share a band of sampled slots; the sketches' distance verifies them, up to what the
    likeness has on average and two standard deviations more.
    """
    bands = np.random.RandomState(11).randint(0, slots, (BANDS, BAND))
    slots_of = lambda fps: (lambda x: np.stack([x >> 4, x & 15], axis=2).reshape(len(x), -1))(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1))

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(sketch=[x.tobytes() for x in sketch(slots_of(pdf["fp"]))])

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                every = slots_of(pdf["fp"]).astype(np.int64)
                for b, pick in enumerate(bands):
                    value = (every[:, pick] << (4 * np.arange(BAND))).sum(axis=1)
                    yield pd.DataFrame({"key": value | b << (4 * BAND), "fp": pdf["sketch"]})

    prints_ = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")).mapInPandas(sketched, "fp binary, least long, sketch binary"), "prints")
    nodes = materialise(prints_.groupBy(F.col("sketch").alias("fp")).agg(F.min("least").alias("least")), "nodes")
    rows = prints_.select("fp", "sketch").mapInPandas(keyed, "key long, fp binary").distinct()
    found = class_ids(nodes, bucket_links(rows, near_radius(like, slots)))
    return prints_.select("fp", "sketch").join(found.withColumnRenamed("fp", "sketch"), "sketch").select("fp", "component_id")


def near_classes(docs: DataFrame, like: float = LIKENESS, slots: int = SLOTS) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    own = materialise(fingerprints(docs, slots), "editprints")
    return own.join(near_table(own, like, slots), "fp").select("doc_id", "fp", "component_id")


def in_order(docs: DataFrame) -> DataFrame:
    """k, h, text, b, own: every document in its range b of ids, and once more, with own false, the row that follows range b.

    k is the id (nulls first), h splits a frequent one.  Ids are split into ranges by quantiles of the id column alone, and
    an id with more than a range's share of the rows into ranges of a hash of the text; only the first row of each range
    is sent twice.  The rows of a range are not a group: a task sorts and streams them.
    """
    spark = docs.sparkSession
    least = -(2**63)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    n = parts(spark)
    cuts = {(int(c), least) for c in docs.stat.approxQuantile("k", [i / n for i in range(1, n)], 0.01 / n if n < 1000 else 1e-5)} if n > 1 else set()
    often = [r["k"] for r in docs.groupBy("k").count().where(F.col("count") > docs.count() / n).where("count > 1000").collect()]  # fewer than n
    cuts |= {(k, least + i * (2**64 // SPLIT)) for k in often for i in range(SPLIT)} | {(k + 1, least) for k in often if k < 2**63 - 1}
    docs = docs.withColumn("h", F.when(F.col("k").isin(often), F.xxhash64("text")).otherwise(F.lit(0)) if often else F.lit(0).cast("long"))
    # the number of cuts at or below a row's place, by a sorted array of so many places
    table = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h")) for k, h in sorted(cuts)])
    ranged = docs.withColumn("b", F.size(F.filter(table, lambda c: (c["k"] < F.col("k")) | ((c["k"] == F.col("k")) & (c["h"] <= F.col("h"))))) if cuts else F.lit(0))
    heads = sorted((r["b"], tuple(r["head"])) for r in ranged.groupBy("b").agg(F.min(F.struct("k", "h")).alias("head")).collect())  # a row a range
    before = [heads[i - 1][0] for i in range(len(heads))]
    first = F.broadcast(spark.createDataFrame([(p, *head) for p, (_, head) in zip(before, heads, strict=True)] or [(0, 0, 0)], "prev int, k long, h long"))
    again = docs.join(first, ["k", "h"]).groupBy("prev", "k", "h").agg(F.min("text").alias("text"))
    again = again.select("k", "h", "text", F.col("prev").alias("b"), F.lit(False).alias("own"), F.lit(None).cast("long").alias("doc_id"))
    return ranged.select("k", "h", "text", "b", F.lit(True).alias("own"), "doc_id").unionByName(again)


def edits(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Each text beside its edited form: the last half replaced by as much of the next text's beginning.

    One shuffle of the texts brings the ranges together; within a range the rows stream in order and a row waits for
    the next one only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = moves()
        held: list[tuple[int | None, str, int, bool]] = []
        size = 0
        for pdf in batches:
            for row in zip(pdf["doc_id"], pdf["text"], pdf["b"], pdf["own"], strict=True):
                held.append((None if pd.isna(row[0]) else int(row[0]), row[1], row[2], row[3]))
                size += len(held[-1][1]) + 64
                if size > 3_000_000:
                    yield prints(held, len(held) - 1, table, slots)
                    held, size = held[-1:], 0
        if held:
            yield prints(held, len(held), table, slots)

    rows = in_order(docs)
    dealt = rows.repartition(parts(docs.sparkSession), "b").sortWithinPartitions("b", F.desc("own"), "k", "h", "text")
    return dealt.select("doc_id", "text", "b", "own").mapInPandas(run, RESULT)


def prints(rows: list[tuple[int | None, str, int, bool]], n: int, table: Callable[[int], np.ndarray], slots: int) -> pd.DataFrame:
    """Results of the first n rows that are their range's own; a row without a next one in its range is its own next."""
    texts = [r[1] for r in rows]
    plain = embed(texts, table, slots)
    keep = [i for i in range(n) if rows[i][3]]
    after = [i + 1 if i + 1 < len(rows) and rows[i + 1][2] == rows[i][2] else i for i in keep]
    edited = []
    for i, k in zip(keep, after, strict=True):
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[k][:half])
    other = embed(edited, table, slots)
    out = {
        "doc_id": pd.array([rows[i][0] for i in keep], dtype="Int64"),
        "n_chars": np.fromiter((len(texts[i]) for i in keep), np.int64, len(keep)),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": to_hex(plain[keep]),
        "edited_fingerprint": to_hex(other),
        "near_edited": likeness(plain[keep], other),
        "near_next": likeness(plain[keep], plain[after]),
    }
    return pd.DataFrame(out)
