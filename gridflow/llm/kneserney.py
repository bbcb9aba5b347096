"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Trusted documents are those that a label table calls good.  Their byte n-grams are counted by language: blocks of
documents list their distinct n-grams and meet in packs by bucket (see `ngrams`); continuation counts, contexts' totals
and the three discounts of each order come from joins over the distinct n-grams.  Each block of documents then gets the
counts that its own distinct n-grams need, and gives every document its perplexity.  A language's threshold comes from
quantiles over trusted documents that the model has not counted (one fold in `FOLDS`; where a language has none there,
over all its trusted ones): the upper quantile plus `slack` times its distance from the median; a short text's own limit is
higher by the scatter of a short sum.

A discount that the counts of counts do not give as a positive number is half its count, so every back-off weight is
positive, the last model below all is the uniform one over bytes, and no perplexity is infinite.

Defined results: a null text is empty, has perplexity 1 over its end mark's model and is kept like any other by the
threshold; a null language is `und`, a language of its own; a language without trusted documents has no threshold and
its documents are kept; repeated rows are scored each for itself; labels may repeat (any good one counts) or be null
(not good); empty tables give none.  Only doc_id, text and lang are read, and doc_id and quality of the labels.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ngrams
from .common import crc_fold, materialise, parts

ORDER = 4
#: One trusted document in so many is kept from the model and gives the thresholds.
FOLDS = 5
#: Upper quantile of trusted perplexities, and how far beyond it a document may lie, as a share of its distance from the median.
QUANTILE, SLACK = 0.99, 0.25
#: A short text's perplexity scatters: its limit is higher by this over the root of its symbols (in log2).
SHORT = 4.0
#: The thresholds are broadcast up to so many languages, counted.
MOST_BROADCAST = 10_000
#: Steps of log2 perplexity in which quantiles are taken.
STEP = 0.001
#: Bytes of text for each bucket of n-grams.
BUCKET = 32_000_000
#: Multiplier that spreads n-grams over buckets, within a long.
ODD = 1_540_483_477
_STATS = ("c", "total", "t1", "t2", "t3")


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of an n-gram; `places` is the same."""
    code = key.bitwiseXOR(F.shiftright(key, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return (F.shiftright(code * F.lit(ODD), 24) % buckets).cast("int")


def places(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys ^ (keys >> 32)) & 0xFFFFFFFF) * ODD >> 24) % buckets


def entries(payload: bytes, flag: np.ndarray | None, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, keys (ascending in each) and counts in flagged documents of a block's distinct n-grams and contexts."""
    code, n = ngrams.stream(payload, order)
    own, at = np.unique(code, return_inverse=True)
    times = np.zeros(len(own)) if flag is None else np.bincount(at, np.repeat(flag, n), len(own))
    keys, counts = ngrams.every_order(own, times, order)
    place = places(keys, buckets)
    at = np.argsort(place, kind="stable")
    return place[at], keys[at], counts[at]


def counted(made: DataFrame, learned: DataFrame, order: int, buckets: int) -> DataFrame:
    """lang, key, c: the learned documents' n-grams over all blocks."""
    seats = made.select("block", F.posexplode("doc_ids").alias("i", "doc_id"))
    good = learned.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    flags = seats.join(good, "doc_id").groupBy("block").agg(F.collect_list("i").alias("good"))  # a block's documents at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                flag = np.zeros(len(r.doc_ids), bool)
                flag[np.asarray(r.good, np.int64)] = True
                place, keys, counts = entries(r.payload, flag, order, buckets)
                some = counts > 0
                place, keys, counts = place[some], keys[some], counts[some]
                packs = [(r.lang, i, ngrams.squeeze_sorted(keys[x]), ngrams.squeeze(counts[x])) for i, x in ngrams.dealt(place)]
                yield pd.DataFrame(packs, columns=["lang", "bucket", "keys", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, at = np.unique(np.concatenate([ngrams.widen_sorted(x) for x in pdf["keys"]]), return_inverse=True)
        c = np.bincount(at, np.concatenate([ngrams.widen(x) for x in pdf["counts"]]).astype(np.float64))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "key": keys.astype(np.int64), "c": c.astype(np.int64)})

    rows = made.select("block", "lang", "doc_ids", "payload").join(flags.hint("shuffle_hash"), "block")
    packs = rows.mapInPandas(run, "lang string, bucket int, keys binary, counts binary")
    return packs.groupBy("lang", "bucket").applyInPandas(add, "lang string, key long, c long")


def model(raw: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """(lang, key and the columns of _STATS; lang and discounts), of counted n-grams.

    c: an n-gram's count, below the highest order in how many different longer ones it ends; total, t1, t2, t3: of all
    that follows a context, and the different n-grams there with a count of one, two and more; discounts: the three of
    each order, in a row.
    """
    raw = materialise(raw.where(ngrams.order_of(F.col("key")) > 0), "raw")
    k = ngrams.order_of(F.col("key"))
    longer = raw.where(k > 1).groupBy("lang", ngrams.suffix_of(F.col("key")).alias("key")).agg(F.count("*").alias("c"))
    counts = materialise(raw.where(k == order).unionByName(longer).withColumn("k", k.cast("int")), "counts")
    cc = counts.groupBy("lang", "k").agg(*[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    d = lambda i: F.when(F.col(f"n{i}") > 0, i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))
    fair = lambda i: F.when((d(i) > 0) & (d(i) < i), d(i)).otherwise(0.5 * i)
    discounts = cc.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", *[fair(i).alias(f"d{i}") for i in (1, 2, 3)]))).alias("cuts"))  # a row an order
    of = lambda c: F.count(F.when(c, 1))
    contexts = counts.groupBy("lang", ngrams.prefix_of(F.col("key")).alias("key")).agg(
        F.sum("c").alias("total"), of(F.col("c") == 1).alias("t1"), of(F.col("c") == 2).alias("t2"), of(F.col("c") > 2).alias("t3")
    )
    both = counts.select("lang", "key", "c").join(contexts, ["lang", "key"], "full")
    return both.select("lang", "key", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in _STATS]), discounts


def perplexities(docs: DataFrame, learned: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, text_hash, n_symbols and log2_perplexity of every document; the model is that of the documents with an id of `learned`."""
    # written in buckets of the block number: the joins on it move what comes back to a block, never its text
    spark = docs.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    ngrams.blocks(docs, by="lang").write.option("compression", "zstd").bucketBy(parts(spark), "block").saveAsTable(name)
    try:
        return materialise(_scored(spark.table(name), learned, order), "scored")
    finally:
        spark.sql(f"DROP TABLE {name}")


def _scored(made: DataFrame, learned: DataFrame, order: int) -> DataFrame:
    buckets = 1 + made.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("all")).first()["all"] // BUCKET
    stats, discounts = model(counted(made, learned, order, buckets), order)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                place, keys, _ = entries(r.payload, None, order, buckets)
                yield pd.DataFrame([(r.lang, r.block, i, ngrams.squeeze_sorted(keys[x])) for i, x in ngrams.dealt(place)], columns=["lang", "block", "bucket", "keys"])

    def answer(packs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """A bucket's statistics for each block's keys, in their order."""
        if not len(packs):
            return pd.DataFrame(columns=["block", "bucket", *_STATS])
        known = known.sort_values("key")
        own, rows = known["key"].to_numpy(np.int64), np.vstack([known[list(_STATS)].to_numpy(np.int64), np.zeros((1, len(_STATS)), np.int64)])
        keys = [ngrams.widen_sorted(x).astype(np.int64) for x in packs["keys"]]
        every = np.concatenate(keys)
        at = np.searchsorted(own, every)
        at[(at < len(own)) & (np.append(own, -1)[at] != every)] = len(own)  # unknown: noughts
        out = packs[["block", "bucket"]].copy()
        for i, c in enumerate(_STATS):
            out[c] = [ngrams.squeeze(x) for x in np.split(rows[at, i], np.cumsum(list(map(len, keys)))[:-1])]
        return out

    asked = made.select("lang", "block", "payload").mapInPandas(ask, "lang string, block long, bucket int, keys binary").groupBy("lang", "bucket")
    rows = stats.withColumn("bucket", bucket_of(F.col("key"), buckets)).groupBy("lang", "bucket")
    replies = asked.cogroup(rows).applyInPandas(answer, "block long, bucket int, " + ", ".join(f"{c} binary" for c in _STATS))
    back = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", *_STATS)).alias("got"))  # of one block
    cuts = made.select("block", "lang").join(discounts, "lang").select("block", "cuts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                _, keys, _ = entries(r.payload, None, order, buckets)
                at, got = np.argsort(keys), sorted(r.got, key=lambda x: x["bucket"])
                c, total, *types = (np.concatenate([ngrams.widen(x[s]) for x in got]).astype(np.float64)[at] for s in _STATS)
                keys = keys[at]
                logs = np.log2(ngrams.probabilities(keys, *terms(keys, c, total, types, r.cuts, order), order))
                code, n = ngrams.stream(r.payload, order)
                own, at = np.unique(code, return_inverse=True)
                each = logs[np.searchsorted(keys, ngrams.keys_of(own, order))][at]
                sums = np.add.reduceat(each, np.cumsum(n) - n) if len(n) else np.empty(0)
                yield pd.DataFrame({"doc_id": pd.array(r.doc_ids, dtype="Int64"), "lang": r.lang, "text_hash": r.hashes, "n_symbols": n, "log2_perplexity": -sums / n})

    every = made.select("block", "doc_ids", "hashes", "lang", "payload").join(back.hint("shuffle_hash"), "block").join(cuts.hint("shuffle_hash"), "block", "left")
    return every.mapInPandas(run, "doc_id long, lang string, text_hash long, n_symbols long, log2_perplexity double")


def terms(keys: np.ndarray, c: np.ndarray, total: np.ndarray, types: list[np.ndarray], cuts: list | None, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The discounted probability of each n-gram after its context, and the back-off weight of each context."""
    d = np.zeros((order + 2, 4))
    for x in [] if cuts is None else cuts:
        d[x["k"]] = 0, x["d1"], x["d2"], x["d3"]
    k_of = keys >> ngrams.ORDER_SHIFT
    context = np.searchsorted(keys, ngrams.keys_of((keys & ((1 << ngrams.ORDER_SHIFT) - 1)) >> 8, np.maximum(k_of - 1, 0)))
    all_ = np.maximum(1, total)
    term = (c - d[k_of, np.minimum(c, 3).astype(np.int64)]) / all_[context]
    gamma = np.where(total > 0, sum(d[k_of + 1, i + 1] * t for i, t in enumerate(types)) / all_, 1.0)
    return term, gamma


def thresholds(scored: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """lang, threshold: of log2 perplexity; exact quantiles over all trusted documents, to one step."""
    steps = scored.where("trusted").groupBy("lang", F.floor(F.col("log2_perplexity") / STEP).alias("s")).agg(F.count("*").alias("n"))
    run = Window.partitionBy("lang").orderBy("s")
    upto = steps.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("s"))) * STEP
    found = upto.groupBy("lang").agg(at(0.5).alias("mid"), at(quantile).alias("high"))
    return found.select("lang", (F.col("high") + STEP + slack * (F.col("high") - F.col("mid"))).alias("threshold"))


def classify(docs: DataFrame, trusted: DataFrame, order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK, folds: int = FOLDS) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, keep, trusted, held_out (not counted by the model) and text_hash of every document."""
    good = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    held = crc_fold("doc_id", folds) == 0
    scored = perplexities(docs, good.where(~held), order).join(good, "doc_id", "left")
    scored = scored.withColumn("trusted", F.coalesce("trusted", F.lit(False))).withColumn("held_out", ~F.col("trusted") | held)
    outside = thresholds(scored.where("held_out"), quantile, slack).withColumnRenamed("threshold", "outside")
    limits = thresholds(scored, quantile, slack).join(outside, "lang", "left").select("lang", F.coalesce("outside", "threshold").alias("threshold"))
    limits = materialise(limits, "thresholds")
    if limits.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:  # a row a language; beyond that an ordinary join
        limits = F.broadcast(limits)
    out = scored.join(limits, "lang", "left").withColumn("threshold", F.col("threshold") + SHORT / F.sqrt("n_symbols"))
    return out.select(
        "doc_id", "lang", "n_symbols", F.pow(F.lit(2.0), "log2_perplexity").alias("perplexity"), F.pow(F.lit(2.0), "threshold").alias("threshold"),
        F.coalesce(F.col("log2_perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"), "trusted", "held_out", "text_hash",
    )
