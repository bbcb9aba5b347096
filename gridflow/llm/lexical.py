"""Ranked lexical search: the best documents for each item, by norm buckets of impact vectors.

A document is a vector of impacts, one for each term that some item holds: x = (1000000000 tf) div (1000 tf + 8 m), where m
grows with the document's number of terms.  An item is a vector of term weights w.  The score is the inner product, and a
document's length is that of its impacts times the roots of the weights, as an item's is that of the roots: their product
bounds the score (Cauchy-Schwarz).

Documents go by descending length into buckets of bounded size, each with inverted lists of its own.  The first bucket
gives every item a score to beat, its k-th best.  A bucket is skipped for an item that its longest vector cannot lift to
that score, and so is one whose largest impacts, coordinate by coordinate, cannot.  Inside a bucket the coordinates that can
add most are summed first, up to where the rest alone cannot reach the bar; a document is kept if its part, and the less of
what the other coordinates' largest impacts and the length that is left of both vectors allow, reaches it.  What is kept is
scored again in whole numbers.  Every bound is widened by more than its rounding error, so no document is lost.

The statistics (documents, terms, documents of each term) are counted over all documents.  Documents are read once for each
block of items; a block holds a bounded number of terms, whatever the number of items, and its terms, weights and bars are all
that tasks are sent.  A bucket is scanned where it lies; a task returns at most k documents an item, those that reach the bar.

Defined results: a null text has no terms; an item without terms gives no rows; rows with one item id are one item with the
terms of all, and those without an id are left out; documents of one id are ranked each for itself; a document without an
id counts in the statistics and is never listed; ties go to the smaller id; empty tables give none.  Only the id and text
columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialise

#: Terms (with repeats over items) of a block of items; documents and vector entries of a bucket at most.
BLOCK_TERMS, BUCKET, BUCKET_ENTRIES = 200_000, 4096, 2_000_000
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Bytes that stand in no term become blanks, A-Z become a-z; all bytes of letters beyond ASCII stay.
FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
BLANK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_LISTED = "doc_id long, n long, terms binary, tfs binary"
_BUCKET = "bucket long, ids binary, sizes binary, terms binary, impacts binary, top double"
_HIT = "item_id long, doc_id long, score long"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded size."""
    data = b"" if text is None else text.encode("utf-8", "surrogatepass")
    at = 0
    while at < len(data):
        cut = BLANK.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        yield data[at:end].translate(FOLD).split()
        at = end


def asked_terms(items: DataFrame, id_column: str, text: str) -> DataFrame:
    """item_id and term, distinct."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, t in zip(pdf["item_id"], pdf["text"], strict=True):
                for own in terms(t):
                    yield pd.DataFrame({"item_id": item, "term": list(set(own))}, columns=["item_id", "term"])

    picked = items.select(F.col(id_column).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null")
    return picked.mapInPandas(run, "item_id long, term binary").distinct()


def listed(docs: DataFrame, vocabulary: list[bytes], id_column: str, text: str) -> DataFrame:
    """doc_id, n (terms with repeats), and the terms of the vocabulary (4-byte numbers) with their occurrences."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = number.get
        for pdf in chunks(batches, 2_000_000):
            size, own, names, counts = [], [], [], []
            for t in pdf["text"]:
                n, found = 0, []
                for part in terms(t):
                    n += len(part)
                    got = np.array([get(w, -1) for w in part], np.int32)
                    found.append(np.unique(got[got >= 0], return_counts=True))
                size.append(n)
                if len(found) == 1:
                    own = found[0]
                else:
                    every = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int32)
                    weight = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
                    u, place = np.unique(every, return_inverse=True)
                    own = u, np.bincount(place, weight, len(u))
                names.append(own[0].astype("<i4").tobytes())
                counts.append(own[1].astype("<i4").tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": size, "terms": names, "tfs": counts})

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, _LISTED)


def holders(rows: DataFrame, n_terms: int) -> np.ndarray:
    """The number of documents that hold each term: summed in the tasks, then by term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_terms, np.int64)
        for pdf in batches:
            total += np.bincount(np.frombuffer(b"".join(pdf["terms"]), "<i4"), minlength=n_terms)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"term": held.astype(np.int32), "n": total[held]})

    found = rows.select("terms").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_terms, np.int64)
    out[found["term"]] = found["n"]
    return out


def impact(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term that occurs tf times in a document of n terms weighs there, in whole numbers."""
    m = 10 + (90 * n * documents) // max(1, total)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def buckets(rows: DataFrame, weight: np.ndarray, documents: int, total: int) -> DataFrame:
    """Documents by descending length of their vectors, in buckets of bounded size."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = np.frombuffer(b"".join(pdf["terms"]), "<i4")
            sizes = (pdf["terms"].str.len() // 4).to_numpy(np.int64)
            x = impact(np.frombuffer(b"".join(pdf["tfs"]), "<i4").astype(np.int64), np.repeat(pdf["n"].to_numpy(np.int64), sizes), documents, total)
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(pdf)), sizes), weight[ids] * x.astype(np.float64) ** 2, len(pdf)))
            cuts, raw = np.cumsum(sizes) * 4, x.astype("<i4").tobytes()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "norm": norm, "terms": pdf["terms"], "impacts": [raw[b - 4 * s : b] for b, s in zip(cuts, sizes, strict=True)]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        docs = entries = 0
        for pdf in batches:
            size = (pdf["terms"].str.len() // 4).to_numpy(np.int64)
            a = 0
            while a < len(pdf):
                room = np.searchsorted(np.cumsum(size[a:]) + entries, BUCKET_ENTRIES, "right")
                take = max(min(int(room), BUCKET - docs), 0 if held else 1)
                if take:
                    held.append(pdf.iloc[a : a + take])
                    docs, entries, a = docs + take, entries + int(size[a : a + take].sum()), a + take
                if held and (a < len(pdf) or docs >= BUCKET):
                    yield bucket(pd.concat(held))
                    held, docs, entries = [], 0, 0
        if held:
            yield bucket(pd.concat(held))

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "bucket": [0], "ids": [pdf["doc_id"].to_numpy("<i8").tobytes()], "sizes": [(pdf["terms"].str.len() // 4).to_numpy("<i8").tobytes()],
            "terms": [b"".join(pdf["terms"])], "impacts": [b"".join(pdf["impacts"])], "top": [float(pdf["norm"].max())],
        })

    named = rows.where("doc_id is not null and length(terms) > 0").mapInPandas(measured, "doc_id long, norm double, terms binary, impacts binary")
    ranged = named.repartitionByRange(F.desc("norm"), "doc_id").sortWithinPartitions(F.desc("norm"), "doc_id")
    return ranged.mapInPandas(pack, _BUCKET).withColumn("bucket", F.monotonically_increasing_id())


class Bucket:
    """Documents of like length with inverted lists."""

    def __init__(self, r: object, weight: np.ndarray) -> None:
        self.ids, self.sizes, self.top = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.sizes, "<i8"), r.top
        self.terms, self.x = np.frombuffer(r.terms, "<i4"), np.frombuffer(r.impacts, "<i4").astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        order = np.argsort(self.terms, kind="stable")
        self.rows, self.sorted_x = np.repeat(np.arange(len(self.ids)), self.sizes)[order], self.x[order]
        own, first = np.unique(self.terms[order], return_index=True)
        self.slot = np.full(len(weight), -1)
        self.slot[own] = np.arange(len(own))
        self.first, self.last = first, np.append(first[1:], len(order))
        self.most = np.maximum.reduceat(self.sorted_x, first)
        self.norm2 = np.add.reduceat(weight[self.terms] * self.x.astype(np.float64) ** 2, self.starts)

    def best(self, own: np.ndarray, weight: np.ndarray, bar: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best for an item's terms, of those that reach `bar`, which is 1 at least."""
        length = np.sqrt(weight[own].sum())
        if length * self.top * (1 + 1e-9) + 1 < bar:
            return self.ids[:0], self.x[:0]
        own = own[self.slot[own] >= 0]
        slot, w = self.slot[own], weight[own]
        reach = w * self.most[slot]
        if reach.sum() < bar:
            return self.ids[:0], self.x[:0]
        order = np.argsort(-reach, kind="stable")
        left = np.append(np.cumsum(reach[order][::-1])[::-1], 0)  # what the coordinates from here on can add
        focus = order[: int(np.argmax(left < bar))]
        part, square = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
        for i in focus:
            at = slice(self.first[slot[i]], self.last[slot[i]])
            add = w[i] * self.sorted_x[at]
            part[self.rows[at]] += add
            square[self.rows[at]] += add * self.sorted_x[at].astype(np.float64)
        rest = np.sqrt(max(0.0, float(w.sum() - w[focus].sum())) * np.maximum(0, self.norm2 - square)) * (1 + 1e-9) + 1e-6 * length * np.sqrt(self.norm2) + 1
        kept = np.flatnonzero((part > 0) & (part + np.minimum(rest, left[len(focus)]) >= bar))
        if not len(kept):
            return self.ids[:0], self.x[:0]
        size = self.sizes[kept]
        heads = np.cumsum(size) - size
        entry = np.arange(size.sum()) + np.repeat(self.starts[kept] - heads, size)
        mine = np.zeros(len(self.slot), np.int64)
        mine[own] = w
        score = np.add.reduceat(mine[self.terms[entry]] * self.x[entry], heads)
        kept, score = kept[score >= bar], score[score >= bar]
        top = np.lexsort((self.ids[kept], -score))[:k]
        return self.ids[kept[top]], score[top]


def scan(found: DataFrame, items: list[tuple[int, np.ndarray]], weight: np.ndarray, bars: np.ndarray, k: int) -> DataFrame:
    """The k best documents of each item in each task's buckets, of those that reach the item's bar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in range(len(items))}
        bar = bars.copy()
        for pdf in batches:
            for r in pdf.itertuples():
                own = Bucket(r, weight)
                for i, (_, named) in enumerate(items):
                    ids, score = own.best(named, weight, int(bar[i]), k)
                    if len(ids):
                        ids, score = np.concatenate([best[i][0], ids]), np.concatenate([best[i][1], score])
                        top = np.lexsort((ids, -score))[:k]
                        best[i] = ids[top], score[top]
                        if len(top) == k:
                            bar[i] = max(bar[i], score[top[-1]])
        for i, (ids, score) in best.items():
            if len(ids):
                yield pd.DataFrame({"item_id": items[i][0], "doc_id": ids, "score": score})

    return found.mapInPandas(run, _HIT)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    asked = materialise(asked_terms(items, item_id, text), "asked")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    found = [_block(docs, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k, doc_id, text) for b in range(blocks)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def ranked(hits: DataFrame, k: int) -> DataFrame:
    place: Column = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, asked: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    pdf = asked.toPandas()  # a block's terms
    vocabulary = sorted(map(bytes, set(pdf["term"])))
    number = {t: i for i, t in enumerate(vocabulary)}
    items = [(int(i), np.sort(np.array([number[bytes(t)] for t in part], np.int64))) for i, part in pdf.groupby("item_id")["term"]]
    rows = materialise(listed(docs, vocabulary, doc_id, text), "listed")
    documents, total = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = holders(rows, len(vocabulary))
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    found = materialise(buckets(rows, weight, documents, total), "buckets")
    # the longest vectors give each item a score to beat
    longest = found.agg(F.max_by("bucket", F.struct("top", -F.col("bucket")))).first()[0]
    if longest is None:
        return ranked(scan(found, items, weight, np.ones(len(items), np.int64), k), k)
    first = materialise(scan(found.where(F.col("bucket") == longest), items, weight, np.ones(len(items), np.int64), k), "first")
    kth = {r["item_id"]: r["score"] for r in ranked(first, k).where(F.col("rank") == k).select("item_id", "score").collect()}
    bars = np.array([kth.get(i, 1) for i, _ in items], np.int64)
    return ranked(first.unionByName(scan(found.where(F.col("bucket") != longest), items, weight, bars, k)), k)
