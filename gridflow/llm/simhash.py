"""SimHash near-duplicates, compared bit plane by bit plane.

Fingerprints are made per document; equal ones are one node from there on, so copies cost nothing.  Two fingerprints
of `bits` bits within `radius` of each other agree on at least `blocks - radius` of `blocks` blocks of bits
(pigeonhole), so each distinct fingerprint goes to one bucket per choice of blocks and no pair in reach is missed.

Within a bucket the candidates are stored vertically: word j of plane b holds bit b of candidates 64j to 64j+63.  A
query bit XORed with a plane gives 64 disagreements at once; carry-save adders keep the counts as bit planes too, an
overflow plane marks those beyond the radius, and a block of candidates is abandoned once all are marked.  Small
buckets of one size class are compared together; a large one is dealt out as pairs of tiles of bounded size, which
are tasks of their own.  A tile pair gives the links of a spanning forest, so what leaves it is linear in its rows.

Defined results: null and empty texts have the zero fingerprint, which links like any other; fewer words than a
shingle count as one shingle; repeated rows share a class; an empty table gives none; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, components, hook, materialise, parts, text_bytes
from .ngrams import mix

#: Candidates of a tile, and queries compared at once.
TILE, QUERIES = 4096, 64
SPACE = re.compile(rb"[ \t-\r]")
ONE = np.uint64(1)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(data: bytes, n: int, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The n-word shingles of a lower-cased text, repeats included, in lists of bounded size; fewer words make one shingle, none give none."""
    held: list[bytes] = []
    at, whole = 0, True
    while at < len(data):
        cut = SPACE.search(data, at + piece)
        end = cut.start() if cut else len(data)
        words = held + data[at:end].split()
        at = end
        if len(words) >= n:
            yield [b" ".join(w) for w in zip(*(words[i:] for i in range(n)), strict=False)]
            whole = False
            held = words[len(words) - n + 1 :] if n > 1 else []
        else:
            held = words
    if whole and held:
        yield [b" ".join(held)]


def simhash(data: bytes, shingle: int, seeds: tuple[int, ...]) -> bytes:
    """The fingerprint of a lower-cased text: 8 big-endian bytes per seed; a bit is set if it is in over half the hashes."""
    counts, n = np.zeros((len(seeds), 64), np.int64), 0
    for grams in shingles(data, shingle):
        n += len(grams)
        for i, seed in enumerate(seeds):
            h = np.frombuffer(b"".join([xxhash.xxh64_digest(g, seed) for g in grams]), np.uint8).reshape(-1, 8)
            for a in range(0, len(h), 4096):
                counts[i] += np.unpackbits(h[a : a + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """doc_id and fp, the fingerprint as binary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, 4_000_000):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": [simhash(text_bytes(t), shingle, seeds) for t in pdf["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp binary")


def within(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Masks [n, q, words] of the candidates within `radius` bits of each query.

    planes: uint64 [n, bits, words], bit planes of the candidates of n buckets; queries: bool [n, q, bits].
    """
    n, q, bits = queries.shape
    width = max(1, radius.bit_length())
    out = np.zeros((n, q, planes.shape[2]), np.uint64)
    live = np.arange(n)
    counters = [np.zeros((n, q, planes.shape[2]), np.uint64) for _ in range(width)]
    over = np.zeros((n, q, planes.shape[2]), np.uint64)
    flip = np.where(queries, ALL, np.uint64(0))
    for b in range(bits):
        carry = planes[live, b][:, None, :] ^ flip[live, :, b][:, :, None]
        for c in counters:
            c ^= carry  # sum
            carry &= ~c  # carry out: the bit was set and is clear now
        over |= carry
        if b % 8 == 7 or b == bits - 1:
            beyond = over | _more(counters, radius)
            keep = (beyond != ALL).any(axis=(1, 2))
            if not keep.all():
                live, over = live[keep], over[keep]
                counters = [c[keep] for c in counters]
                if not len(live):
                    return out
    out[live] = ~(over | _more(counters, radius))
    return out


def _more(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the vertical counters hold more than `radius`."""
    more, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            more |= equal & counters[k]
            equal &= ~counters[k]
    return more


def to_planes(bits: np.ndarray) -> np.ndarray:
    """bool [n, rows, bits] to uint64 [n, bits, words]; rows are padded with zeros."""
    n, rows, width = bits.shape
    words = -(-rows // 64)
    full = np.zeros((n, width, words * 64), bool)
    full[:, :, :rows] = bits.transpose(0, 2, 1)
    return np.packbits(full, axis=2, bitorder="little").view("<u8").reshape(n, width, words)


def unpacked(masks: np.ndarray, rows: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=-1, bitorder="little")[..., :rows].astype(bool)


def bits_of(fps: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1).astype(bool)


def small_links(bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (spanning links) within buckets of at most 64 rows; buckets of a size class advance together."""
    us, vs = [], []
    parent = np.arange(len(bits))
    for top in (2, 4, 8, 16, 32, 64):
        mine = np.flatnonzero((sizes <= top) & (sizes > top // 2) & (sizes > 1))
        for a in range(0, len(mine), max(1, 65_536 // (top * top))):
            pick = mine[a : a + max(1, 65_536 // (top * top))]
            rows = starts[pick][:, None] + np.minimum(np.arange(top), sizes[pick][:, None] - 1)
            own = bits[rows]
            near = unpacked(within(to_planes(own), own, radius), top)
            k, i, j = np.nonzero(np.triu(near, 1))
            us.append(rows[k, i])
            vs.append(rows[k, j])
    if not us:
        return np.empty(0, int), np.empty(0, int)
    u, v = np.concatenate(us), np.concatenate(vs)
    hook(parent, u, v)
    child = np.flatnonzero(parent != np.arange(len(bits)))
    return child, parent[child]


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a tile with another (rows of `right` count on after those of `left`), or with itself."""
    every = left if right is None else np.concatenate([left, right])
    parent = np.arange(len(every))
    planes, shift = to_planes((left if right is None else right)[None]), 0 if right is None else len(left)
    for a in range(0, len(left), QUERIES):
        near = unpacked(within(planes, left[None, a : a + QUERIES], radius), len(every) - shift)[0]
        i, j = np.nonzero(near)
        hook(parent, i + a, j + shift)
    child = np.flatnonzero(parent != np.arange(len(every)))
    return child, parent[child]


def links(nodes: DataFrame, bits: int, radius: int, blocks: int) -> DataFrame:
    """(a, b): links between distinct fingerprints within `radius`, enough to connect every class.

    nodes: distinct (fp binary).  Each of the choices of `blocks - radius` blocks out of `blocks` makes a bucket key.
    """
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - radius))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            b = bits_of(list(pdf["fp"]))
            for t, choice in enumerate(choices):
                cut = np.packbits(np.concatenate([b[:, edges[i] : edges[i + 1]] for i in choice], axis=1), axis=1)
                yield pd.DataFrame({"key": [bytes([t]) + k.tobytes() for k in cut], "fp": pdf["fp"]})

    rows = materialise(nodes.mapInPandas(keyed, "key binary, fp binary"), "keyed")
    return bucket_links(rows, radius)


def bucket_links(rows: DataFrame, radius: int, bits: int | None = None) -> DataFrame:
    """(a, b): spanning links within `radius` among the (key, fp) rows of each key, by the first `bits` bits of fp; rows are distinct."""
    spark = rows.sparkSession
    width = None if bits is None else bits // 8
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shards = parts(spark)
    small = rows.join(sizes.where("n <= 64"), "key").select("key", "fp")

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            cut = int(np.flatnonzero((pdf["key"] != pdf["key"].iloc[-1]).to_numpy())[-1]) + 1 if pdf["key"].iloc[0] != pdf["key"].iloc[-1] else 0
            held = pdf.iloc[cut:]
            yield linked(pdf.iloc[:cut])
        if held is not None:
            yield linked(held)

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        code = pd.factorize(pdf["key"])[0]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        child, root = small_links(bits_of([x[:width] for x in pdf["fp"]]), starts, np.diff(np.append(starts, len(pdf))), radius)
        fp = pdf["fp"].to_numpy()
        return pd.DataFrame({"a": fp[root], "b": fp[child]})

    found = small.repartition(shards, "key").sortWithinPartitions("key").mapInPandas(few, "a binary, b binary")

    # a large bucket: tiles of bounded size, and each pair of them a group; every row of a tile goes to the pairs that hold it
    large = rows.join(sizes.where("n > 64"), "key").withColumn("tiles", F.expr(f"cast(ceil(n / {TILE // 2}) as int)"))
    large = large.withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    dealt = large.select("key", "fp", "tile", F.explode(F.expr("sequence(0, tiles - 1)")).alias("other"))
    dealt = dealt.select("key", "fp", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile")

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        first = (pdf["tile"] == i).to_numpy()
        fp = np.concatenate([pdf["fp"].to_numpy()[first], pdf["fp"].to_numpy()[~first]])
        b = bits_of([x[:width] for x in fp])
        child, root = tile_links(b[: first.sum()], None if i == j else b[first.sum() :], radius)
        return pd.DataFrame({"a": fp[root], "b": fp[child]})

    return found.union(dealt.groupBy("key", "i", "j").applyInPandas(pair, "a binary, b binary"))


def classes(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (42,), radius: int = 2, blocks: int = 5) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over fingerprints that differ in `radius` bits or fewer."""
    own = materialise(fingerprints(docs, shingle, seeds), "fingerprints")
    nodes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    return joined(own, nodes, links(nodes.select("fp"), 64 * len(seeds), radius, blocks))


def joined(own: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Each document with the smallest doc_id of its class; hot fingerprints meet only in the last, splittable join."""
    return own.join(class_ids(nodes, found), "fp").select("doc_id", "fp", "component_id")


def class_ids(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """fp and component_id of each node (fp, least) under the links (a, b) between fingerprints.

    A class that holds many nodes gets its smallest id by parts first.
    """
    roots = components(found)
    tops = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tops = materialise(tops, "tops")
    linked = tops.join(roots.select("root").distinct(), "root", "left_semi")
    lowest = linked.groupBy("root", F.pmod(F.xxhash64("fp"), F.lit(64)).alias("part")).agg(F.min("least").alias("low")).groupBy("root").agg(F.min("low").alias("low"))
    lowest = materialise(lowest, "lowest")
    return materialise(tops.join(lowest, "root", "left").select("fp", F.coalesce("low", "least").alias("component_id")), "classes")


#: Near duplicates over five-word shingles: the hash's seed, 64-bit parts of a fingerprint, shingle, similarity (for sets of like size the cosine is
#: 2s / (1 + s), and a bit differs with chance angle / pi), bands and rows of the candidate keys.
NEAR_SEED, NEAR_WORDS, NEAR_SHINGLE, SIMILARITY, BANDS, ROWS = 42, 4, 5, 0.8, 10, 3
ODD = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of shingle hashes in a tile of the exact comparison, and linked sets whose names (16 bytes) are broadcast at most.
TILE_BYTES, MOST_BROADCAST = 8_000_000, 2_000_000


def near_radius(bits: int, similarity: float) -> int:
    """Bits within which all but the rarest pairs of this similarity are: the mean and four standard deviations.

    A bit of two sets of like size differs with chance angle / pi; of sets of four and five shingles, where ties count, with 3 / 16.
    """
    p = max(np.arccos(2 * similarity / (1 + similarity)) / np.pi, 3 / 16)
    return int(bits * p + 4 * np.sqrt(bits * p * (1 - p)))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text without words has one of its own."""
    found = [np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(g, NEAR_SEED) for g in grams]), ">u8").astype(np.uint64)) for grams in shingles(text_bytes(text), shingle)]
    return (found[0] if len(found) == 1 else np.unique(np.concatenate(found))) if found else np.zeros(1, np.uint64)


def set_node(own: np.ndarray, words: int) -> bytes:
    """A set's fingerprint of `words` 64-bit parts, each by another mixture of its hashes, followed by a digest of the whole set."""
    counts = np.zeros((words, 64), np.int64)
    for i in range(words):
        h = own if i == 0 else mix(own + np.uint64(i) * ODD)
        for a in range(0, len(h), 4096):
            counts[i] += np.unpackbits(h[a : a + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(own), axis=1).tobytes() + xxhash.xxh3_128_digest(own.tobytes())


def exact_links(fps: list[bytes], sets: list[bytes], first: np.ndarray | None, bits: int, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the rows whose sets have a Jaccard similarity of `similarity` or more, between `first` rows and the rest, or among all.

    The bit-sliced comparison gives each row its candidates; those not linked yet are compared as sets.
    """
    n = len(fps)
    sizes = np.fromiter((len(x) // 8 for x in sets), np.int64, n)
    code = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    flag = np.zeros(int(code.max()) + 1, bool)
    every = bits_of([x[: bits // 8] for x in fps])
    left = np.arange(n) if first is None else np.flatnonzero(first)
    right = np.arange(n) if first is None else np.flatnonzero(~first)
    parent = np.arange(n)
    planes = to_planes(every[right][None])
    for a in range(0, len(left), QUERIES):
        near = unpacked(within(planes, every[None, left[a : a + QUERIES]], radius), len(right))[0]
        for i, row in zip(left[a : a + QUERIES], near, strict=True):
            other = right[row]
            other = other[(parent[other] != parent[i]) & (np.minimum(sizes[other], sizes[i]) >= similarity * np.maximum(sizes[other], sizes[i]) - 1e-9)]
            if first is None:
                other = other[other > i]
            if not len(other):
                continue
            own = code[starts[i] : starts[i] + sizes[i]]
            flag[own] = True
            heads = np.cumsum(sizes[other]) - sizes[other]
            both = np.add.reduceat(flag[code[np.arange(sizes[other].sum()) + np.repeat(starts[other] - heads, sizes[other])]], heads, dtype=np.int64)
            flag[own] = False
            like = other[both >= similarity * (sizes[other] + sizes[i] - both) - 1e-9]
            hook(parent, np.full(len(like), i), like)
    child = np.flatnonzero(parent != np.arange(n))
    return child, parent[child]


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """doc_id, h, fp, component_id: the smallest doc_id reachable over documents whose shingle sets have a Jaccard similarity of `similarity` or more.

    h is a hash of the text, which tells rows with one id apart.  The radius that this likeness needs is too wide for
    choices of bit blocks, so the buckets are bands of minimum hashes of the shingles (with 10 bands of 3 a pair at 0.8
    shares one with chance 0.999), and the comparison of bits is a filter.  The hash sets of the rows that it links go once
    to their connected group, and only pairs that are alike as sets are links.  A node is a distinct set, and stands for
    its copies.
    """
    bits, radius = 64 * NEAR_WORDS, near_radius(64 * NEAR_WORDS, similarity)
    spark = docs.sparkSession
    odd = (np.random.RandomState(7).randint(1, 2**62, BANDS * ROWS, dtype=np.int64).astype(np.uint64) << ONE) | ONE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, 2_000_000):
            fps, keys, sizes = [], [], []
            for t in pdf["text"]:
                own = shingle_hashes(t, shingle)
                least = np.array([(own * m >> np.uint64(16)).min() for m in odd])
                fps.append(set_node(own, NEAR_WORDS))
                sizes.append(len(own))
                keys.append([bytes([b]) + xxhash.xxh64_digest(least[b * ROWS : (b + 1) * ROWS].tobytes()) for b in range(BANDS)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "h": pdf["h"], "fp": fps, "keys": keys, "size": sizes})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    own = materialise(picked.mapInPandas(run, "doc_id long, h long, fp binary, keys array<binary>, size long"), "near")
    nodes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("one"), F.min("size").alias("size")), "nodes")
    rows = materialise(own.groupBy("fp").agg(F.first("keys").alias("keys")).select(F.explode("keys").alias("key"), "fp"), "keyed")
    # what the filter links, by connected groups: every pair that shares a bucket and passes it lies in one group
    linked = components(bucket_links(rows.select("key", "fp"), radius, bits)).select(F.col("node").alias("fp"), F.xxhash64("root").alias("key"))
    linked = materialise(linked.join(nodes, "fp").select("fp", "key", F.col("one.doc_id").alias("id_"), F.col("one.h").alias("h"), "size"), "linked")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, 2_000_000):
            made = [shingle_hashes(t, shingle) for t in pdf["text"]]
            yield pd.DataFrame({"fp": [set_node(h, NEAR_WORDS) for h in made], "hashes": [h.tobytes() for h in made]})

    # of each linked set the hashes of one text that has it
    wanted = linked.select("h", "id_").distinct()
    if linked.count() <= MOST_BROADCAST:  # then no text is moved
        wanted = F.broadcast(wanted)
    sets = picked.join(wanted, (picked["h"] == wanted["h"]) & F.col("doc_id").eqNullSafe(F.col("id_")), "left_semi").select("text").mapInPandas(listed, "fp binary, hashes binary")
    sets = materialise(sets.join(linked.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "sets")

    # every group in tiles of bounded rows and bytes, and each pair of tiles a task's work
    tiles = linked.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("all"))
    tiles = tiles.select("key", F.expr(f"cast(greatest(ceil(n / {TILE // 2}), ceil(all * 8 / {TILE_BYTES})) as int)").alias("tiles"))
    dealt = linked.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    dealt = dealt.select("key", "fp", "tile", F.explode(F.expr("sequence(0, tiles - 1)")).alias("other"))
    dealt = dealt.select("key", "fp", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile").join(sets, "fp")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        group = None
        for pdf in batches:
            out: list[tuple[bytes, bytes]] = []
            for key, i, j, tile, fp, hashes in zip(pdf["key"], pdf["i"], pdf["j"], pdf["tile"], pdf["fp"], pdf["hashes"], strict=True):
                if (key, i, j) != group:
                    out += pairs(held, group)
                    held, group = [], (key, i, j)
                held.append((tile, fp, hashes))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=object)
        yield pd.DataFrame(pairs(held, group), columns=["a", "b"], dtype=object)

    def pairs(held: list[tuple], group: tuple | None) -> list[tuple[bytes, bytes]]:
        if len(held) < 2:
            return []
        first = None if group[1] == group[2] else np.array([t == group[1] for t, _, _ in held])
        if first is not None and (first.all() or not first.any()):
            return []
        child, root = exact_links([x for _, x, _ in held], [x for _, _, x in held], first, bits, radius, similarity)
        return [(held[r][1], held[c][1]) for c, r in zip(child, root, strict=True)]

    ordered = dealt.repartition(parts(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    table = class_ids(nodes.select("fp", "least"), ordered.mapInPandas(compared, "a binary, b binary"))
    return own.select("doc_id", "h", "fp").join(table, "fp").select("doc_id", "h", "fp", "component_id")


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: the smallest doc_id of each class, once; a row without an id stays.

    Of several texts with that id in the class, the one with the smallest hash stays.
    """
    keep = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("h").alias("h_")).withColumnRenamed("doc_id", "id_")
    rows = docs.withColumn("hash_", F.xxhash64("text")).join(keep, (F.col("doc_id") == F.col("id_")) & (F.col("hash_") == F.col("h_")), "left").where("id_ is not null or doc_id is null")
    rows = rows.withColumn("turn_", F.row_number().over(Window.partitionBy("doc_id", "hash_").orderBy(F.lit(0)))).where("turn_ = 1 or doc_id is null")
    return rows.select(*[docs[c] for c in docs.columns])
