"""Language-model scores by a weighted back-off automaton.

A token's spelling is scored by an automaton.  Its symbols (a word's bytes and a space, or the end mark) go one by one:
contexts of up to `order` - 1 bytes are states, a seen n-gram is an arc from its context to the longest context that ends
it, and a state's failure arc leads, at the cost of the back-off weight, to its context without the first byte.  The state
is carried on through all tokens.  One traversal from left to right adds up log probabilities; documents advance together,
long ones in segments that begin `order` - 1 bytes early, after which the state is the same as in one run.

Tokens and pairs of tokens are no states of it: what an arc of theirs would cost depends on the spelling where the token
stands, so they are interpolated with the spelling's score by the formula below, for all places of a block at once.

Weights: interpolated Witten-Bell on the spelling level, interpolated absolute discounting on the token level, so an arc
costs what its own counts and what lies below it give together:

    A(t)       what the spelling level gives the token's symbols where it stands
    P(t)     = (1 - SPELLED) * (max(c(t) - D, 0) + D * V * A(t)) / N + SPELLED * A(t)
    P(t | s) = (max(c(s, t) - D, 0) + D * T(s) * P(t)) / c(s)

with N and V all and distinct training tokens and T(s) the different tokens that follow s.  Nothing is held for an unseen
token but its spelling, so the model is open and adds up to one.  The base score comes from the same counts.

Counts: training documents' entries are counted by block and summed over all blocks (see `ngrams`); what grows with the
input is dealt out to buckets of bounded size, pairs of tokens by the hash of the pair, so that a frequent token is no
hot key.  T is counted without moving pairs to their first token: the bucket of a pair names one block that counts it.

Defined results: a null or empty text has its end mark only; without training documents every symbol has the uniform
probability and the base score is that of counts of nought over V = N = 0; repeated rows are scored and counted each
for itself; a null id counts as the empty text in the fold and is not held out by it unless its hash says so; an
empty table gives none.  Only the id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import materialise, parts

ORDER = 5
#: Discount of the token level, and share of the spelling in a token's probability there.
DISCOUNT, SPELLED = 0.75, 0.5
#: Symbols of a traversal segment.
SEGMENT = 384
#: Bytes of text in a block, and for each bucket.
BLOCK, BUCKET = 3_000_000, 16_000_000
SPACE = 32
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_REPLY = "block long, kind string, bucket int, one binary, two binary, three binary, train_tokens long, train_types long"

class Table:
    """A hash table from non-negative longs to their places, probed for many keys at once."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]  # the last of several wins; the others go on
            placed = self.keys[slot] == keys[left]
            self.at[slot[placed]] = left[placed]
            slot, left = (slot[~placed] + 1) & self.mask, left[~placed]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.at[slot], -1)
        open_ = np.flatnonzero((got != keys) & (got != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            got = self.keys[slot[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.at[slot[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out


class Automaton:
    """States, arcs and failure arcs over the n-grams of a block.

    keys: sorted n-gram keys, of every order at every place of the block; term: discounted probability after the
    context (0: not seen); gamma: back-off weight of the context (1: not seen).
    """

    def __init__(self, keys: np.ndarray, term: np.ndarray, gamma: np.ndarray, order: int) -> None:
        k_of, code = keys >> ngrams.ORDER_SHIFT, keys & ((1 << ngrams.ORDER_SHIFT) - 1)
        self.order, self.floor, self.root = order, np.log10(1 / 256), 0
        up = ngrams.keys_of(code >> 8, k_of - 1)
        # contexts that training has seen, the root first; shorter ones have smaller keys
        self.states, first = np.unique(np.append(up[gamma < 1], 0), return_index=True)
        weights = np.append(gamma[gamma < 1], gamma[0] if len(gamma) and up[0] == 0 else 1.0)
        self.back = np.log10(weights[first])
        p = np.full(len(keys), 1 / 256)
        for k in range(1, order + 1):
            at = np.flatnonzero(k_of == k)
            below = p[np.searchsorted(keys, ngrams.keys_of(ngrams.lower(code[at], k - 1), k - 1))] if k > 1 else 1 / 256
            p[at] = term[at] + gamma[at] * below
        k_state, c_state = self.states >> ngrams.ORDER_SHIFT, self.states & ((1 << ngrams.ORDER_SHIFT) - 1)
        self.fail = self.longest(c_state, k_state - 1)
        arcs = np.flatnonzero(term > 0)
        self.table = Table(np.searchsorted(self.states, up[arcs]) << 8 | (code[arcs] & 255))
        # one entry more, so that a model without arcs has one to stand in
        self.cost = np.append(np.log10(p[arcs]), 0.0)
        self.to = np.append(self.longest(code[arcs], np.minimum(k_of[arcs], order - 1)), self.root)

    def longest(self, code: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The state of the longest suffix of at most k bytes that is a context."""
        out = np.zeros(len(code), np.int64)
        todo = np.ones(len(code), bool)
        for n in range(self.order - 1, 0, -1):
            own = np.flatnonzero(todo & (k >= n))
            want = ngrams.keys_of(ngrams.lower(code[own], n), n)
            at = np.searchsorted(self.states, want)
            at[at == len(self.states)] = 0
            hit = self.states[at] == want
            out[own[hit]] = at[hit]
            todo[own[hit]] = False
        return out

    def start(self) -> int:
        """The state before a document: the end marks that precede it."""
        marks = sum(ngrams.END << (8 * i) for i in range(self.order - 1))
        return int(self.longest(np.array([marks]), np.array([self.order - 1]))[0])

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log10 probabilities of one symbol each."""
        at = self.table.find(state << 8 | symbol)
        out, score = self.to[at], self.cost[at]  # most have an arc; the last arc stands in for the others until they fail
        open_ = np.flatnonzero(at < 0)
        here, paid = state[open_], np.zeros(len(open_))
        while len(open_):
            paid += self.back[here]
            lost = here == self.root
            out[open_[lost]], score[open_[lost]] = self.root, paid[lost] + self.floor
            open_, paid, here = open_[~lost], paid[~lost], self.fail[here[~lost]]
            at = self.table.find(here << 8 | symbol[open_])
            hit = at >= 0
            out[open_[hit]], score[open_[hit]] = self.to[at[hit]], paid[hit] + self.cost[at[hit]]
            open_, paid, here = open_[~hit], paid[~hit], here[~hit]
        return out, score

    def run(self, payload: bytes) -> np.ndarray:
        """log10 probability of each symbol of a block after all before it in its document."""
        symbols = np.frombuffer(payload, np.uint8).astype(np.int64)
        ends = np.flatnonzero(symbols == ngrams.END)
        n = np.diff(ends, prepend=-1)
        count = -(-n // SEGMENT)
        doc = np.repeat(np.arange(len(n)), count)
        index = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        warm = np.where(index > 0, self.order - 1, 0)
        begin = (ends - n + 1)[doc] + index * SEGMENT - warm
        size = np.minimum(SEGMENT, n[doc] - index * SEGMENT) + warm
        order = np.argsort(-size, kind="stable")
        begin, size, warm = begin[order], size[order], warm[order]
        state = np.where(warm > 0, self.root, self.start())
        out = np.zeros(len(symbols), np.float32)
        live = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")
        for j, m in enumerate(live):
            at = begin[:m] + j
            state[:m], score = self.step(state[:m], symbols[at])
            if j < self.order - 1:
                kept = j >= warm[:m]
                at, score = at[kept], score[kept]
            out[at] = score
        return out


class Tokens:
    """The token stream of a block: codes in order with an end mark (the last code) after each document, and their words."""

    def __init__(self, payload: bytes) -> None:
        symbols = np.frombuffer(payload, np.uint8)
        self.ends = np.flatnonzero((symbols == SPACE) | (symbols == ngrams.END))  # of each token: the space after a word, or the mark itself
        bounds = pa.py_buffer(np.append(0, self.ends + 1).astype(np.int64))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.ends), [None, bounds, pa.py_buffer(payload)]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy()
        # the end mark, which no word equals, gets the last code, and the empty word stands for it
        mark = words.index(b"\n") if words else 0
        shifted = np.arange(len(words), dtype=np.int64) - (np.arange(len(words)) > mark)
        shifted[mark : mark + 1] = len(words) - 1
        self.codes = shifted[codes]
        self.words = [*(w[:-1] for i, w in enumerate(words) if i != mark), b""]
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        self.last = np.flatnonzero(symbols[self.ends] == ngrams.END)
        self.n = np.diff(self.last, prepend=-1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct pairs of neighbours in ascending order, their first and second codes' pair of each place, and first codes."""
        v = len(self.words)
        both = np.append(v - 1, self.codes[:-1]) * v + self.codes
        at, own = pd.factorize(both)
        hashes = ngrams.mix(ngrams.mix(self.hashes[own // v]) ^ self.hashes[own % v])
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return hashes[order], rank[at], own[order] // v

    def order(self) -> np.ndarray:
        return np.argsort(self.hashes, kind="stable")


def spelling(payload: bytes, train: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, keys and training counts of a block's distinct n-grams; a context's n-grams share a bucket (256 at most of each block)."""
    code, n = ngrams.stream(payload, order)
    flag = np.repeat(train, n)
    keys, counts = ngrams.distinct_of_every_order(code[flag], code[~flag], order)
    places = ngrams.place_of(ngrams.mix(context_of(keys)), buckets)
    at = np.argsort(places, kind="stable")
    return places[at], keys[at], counts[at]


def context_of(keys: np.ndarray) -> np.ndarray:
    return (keys & ((1 << ngrams.ORDER_SHIFT) - 1)) >> 8 | (keys >> ngrams.ORDER_SHIFT) << ngrams.ORDER_SHIFT


def meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """The packs of one bucket from all blocks: sums over blocks, sent back to each block in its own order.

    Of an n-gram: its count, its context's total and types.  Of a pair: twice its count, and one more for the block that
    counts the pair among what follows its first token.
    """
    own = [ngrams.widen_sorted(x) for x in pdf["keys"]]
    cuts = np.cumsum(list(map(len, own)))[:-1]
    counts = np.concatenate([ngrams.widen(x) for x in pdf["counts"]]).astype(np.float64)
    keys, first, code = np.unique(np.concatenate(own), return_index=True, return_inverse=True)
    seen = np.bincount(code, counts, len(keys)).astype(np.int64)
    out = pdf[["block", "kind", "bucket"]].copy()
    if pdf["kind"].iloc[0] == "n":
        context = np.unique(context_of(keys.astype(np.int64)), return_inverse=True)[1]
        total, types = np.bincount(context, seen).astype(np.int64), np.bincount(context, seen > 0).astype(np.int64)
        sent = [seen[code], total[context][code], types[context][code]]
    else:
        twice = 2 * seen[code]
        twice[first[seen > 0]] += 1
        sent = [twice]
    for name, values in zip(("one", "two", "three"), sent, strict=False):
        out[name] = [ngrams.squeeze(x) for x in np.split(values, cuts)]
    return out.reindex(columns=["block", "kind", "bucket", "one", "two", "three"]).assign(train_tokens=0, train_types=0)


def meet_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """The same for words: counts and followers of each."""
    words = pa.concat_arrays([pc.split_pattern(pa.scalar(x, pa.large_binary()), b"\n").values for x in pdf["keys"]])
    counts, types = ([ngrams.widen(x) for x in pdf[c]] for c in ("counts", "types"))
    cuts = np.cumsum(list(map(len, counts)))[:-1]
    code = words.dictionary_encode().indices.to_numpy()
    total, followed = (np.bincount(code, np.concatenate(x).astype(np.float64)).astype(np.int64) for x in (counts, types))
    out = pdf[["block", "bucket"]].copy()
    out["kind"] = "w"
    out["one"] = [ngrams.squeeze(x) for x in np.split(total[code], cuts)]
    out["two"] = [ngrams.squeeze(x) for x in np.split(followed[code], cuts)]
    out["three"] = b""
    out["train_tokens"], out["train_types"] = 0, 0
    out.iloc[0, out.columns.get_loc("train_tokens")] = int(total.sum())
    out.iloc[0, out.columns.get_loc("train_types")] = int((total > 0).sum())
    return out[["block", "kind", "bucket", "one", "two", "three", "train_tokens", "train_types"]]


def values(replies: list, name: str) -> np.ndarray:
    """A block's values from its buckets' replies, in the order of its entries."""
    own = sorted(replies, key=lambda x: x["bucket"])
    return np.concatenate([ngrams.widen(x[name]) for x in own]).astype(np.int64) if own else np.empty(0, np.int64)


def log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 of the sum of two numbers given by their log10; -inf is nought."""
    top = np.maximum(a, b)
    top[np.isneginf(top)] = 0.0  # nought and nought
    return top + np.log10(10.0 ** (a - top) + 10.0 ** (b - top))


def score(docs: DataFrame, held_out: Callable[[Column], Column], order: int = ORDER) -> DataFrame:
    """The columns of RESULT for every document; the model learns from documents that are not held out.

    held_out: the fold of a document, by its id alone.
    """
    # written in buckets of the block number: the joins on it move what comes back to a block, never its text
    spark = docs.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    made = ngrams.blocks(docs, after=b" ", block=BLOCK).withColumn("held", F.transform("doc_ids", held_out))
    made.write.option("compression", "zstd").bucketBy(parts(spark), "block").saveAsTable(name)
    try:
        return materialise(_scored(spark.table(name), order), "scored")
    finally:
        spark.sql(f"DROP TABLE {name}")


def _scored(made: DataFrame, order: int) -> DataFrame:
    size = made.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("all")).first()["all"]
    buckets = 1 + size // BUCKET

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's distinct n-grams and pairs of tokens, in packs by bucket."""
        for pdf in batches:
            for r in pdf.itertuples():
                train = ~np.asarray(r.held, bool)
                places, keys, counts = spelling(r.payload, train, order, buckets)
                packs = [(r.block, "n", i, ngrams.squeeze_sorted(keys[x]), ngrams.squeeze(counts[x])) for i, x in ngrams.dealt(places)]
                tokens = Tokens(r.payload)
                keys, at, _ = tokens.pairs()
                counts = np.bincount(at, np.repeat(train, tokens.n), len(keys)).astype(np.int64)
                packs += [(r.block, "p", i, ngrams.squeeze_sorted(keys[x]), ngrams.squeeze(counts[x])) for i, x in ngrams.dealt(ngrams.place_of(keys, buckets))]
                yield pd.DataFrame(packs, columns=["block", "kind", "bucket", "keys", "counts"])

    packs = made.select("block", "payload", "held").mapInPandas(count, "block long, kind string, bucket int, keys binary, counts binary")
    replies = materialise(packs.groupBy("kind", "bucket").applyInPandas(meet, _REPLY), "replies")
    of_kind = lambda rows, k: rows.where(F.col("kind") == k).groupBy("block").agg(F.collect_list(F.struct("bucket", "one", "two", "three")).alias(k))
    pairs = of_kind(replies, "p")  # of one block

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                tokens = Tokens(r.payload)
                counts = np.bincount(tokens.codes, np.repeat(~np.asarray(r.held, bool), tokens.n), len(tokens.words)).astype(np.int64)
                _, _, first = tokens.pairs()
                types = np.bincount(first, values(r.p, "one") & 1, len(tokens.words)).astype(np.int64)
                at = tokens.order()
                yield pd.DataFrame(
                    [(r.block, i, b"\n".join(tokens.words[k] for k in at[x]), ngrams.squeeze(counts[at[x]]), ngrams.squeeze(types[at[x]])) for i, x in ngrams.dealt(ngrams.place_of(tokens.hashes[at], buckets))],
                    columns=["block", "bucket", "keys", "counts", "types"],
                )

    packs = made.select("block", "payload", "held").join(pairs.hint("shuffle_hash"), "block").mapInPandas(count_words, "block long, bucket int, keys binary, counts binary, types binary")
    words = materialise(packs.groupBy("bucket").applyInPandas(meet_words, _REPLY), "words")
    whole = words.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("train_types"), F.lit(0)).alias("v")).first()  # one row
    n_all, distinct = int(whole["n"]), int(whole["v"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                _, keys, _ = spelling(r.payload, np.ones(len(r.doc_ids), bool), order, buckets)
                seen, total, types = (values(r.n, c) for c in ("one", "two", "three"))
                both = np.maximum(1, total + types)
                at = np.argsort(keys)
                symbols = Automaton(keys[at], (seen / both)[at], np.where(total > 0, types / both, 1.0)[at], order).run(r.payload)
                tokens = Tokens(r.payload)
                spelt = np.add.reduceat(symbols, np.append(0, tokens.ends[:-1] + 1), dtype=np.float64) if len(tokens.ends) else np.empty(0)
                c, followers = np.empty(len(tokens.words)), np.empty(len(tokens.words))
                c[tokens.order()], followers[tokens.order()] = values(r.w, "one"), values(r.w, "two")
                _, at, first = tokens.pairs()
                own = weighed(c[tokens.codes], (values(r.p, "one") >> 1)[at], c[first][at], followers[first][at], spelt, n_all, distinct)
                base = (np.log10(c + 1.0) - np.log10(n_all + 1.0 * (distinct + 1)))[tokens.codes]
                begin = tokens.last - tokens.n + 1
                total_of = lambda x: np.add.reduceat(x, begin) if len(begin) else np.empty(0)  # noqa: E731, B023
                yield pd.DataFrame({
                    "doc_id": pd.array(r.doc_ids, dtype="Int64"), "held_out": np.asarray(r.held, bool), "n_tokens": tokens.n,
                    "n_known": total_of((c[tokens.codes] > 0).astype(np.int64)), "train_tokens": n_all, "base_score": total_of(base), "score": total_of(own),
                })

    every = made.select("block", "doc_ids", "held", "payload")
    for rows in (of_kind(replies, "n"), pairs, of_kind(words, "w")):
        every = every.join(rows.hint("shuffle_hash"), "block")
    return every.drop("block").mapInPandas(run, RESULT)


def weighed(c: np.ndarray, both: np.ndarray, before: np.ndarray, followers: np.ndarray, spelt: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 P(t | s) of each token: c(t), c(s, t), c(s), T(s) and log10 A(t) given."""
    if not n:
        return spelt
    with np.errstate(divide="ignore"):
        alone = log_sum(np.log10((1 - SPELLED) * np.maximum(c - DISCOUNT, 0) / n), np.log10((1 - SPELLED) * DISCOUNT * v / n + SPELLED) + spelt)
        known = before > 0
        size = np.maximum(1, before)
        after = log_sum(np.log10(np.maximum(both - DISCOUNT, 0) / size), np.log10(DISCOUNT * followers / size) + alone)
    return np.where(known, after, alone)
