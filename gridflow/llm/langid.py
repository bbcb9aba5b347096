"""Language identification by compression.

Each language has a dictionary of raw text.  A text, reduced to lower-cased words, is compressed with every dictionary
by zstandard, in pieces of bounded length whose sizes are added, so that the margin's share does not fall with length;
the language whose dictionary gives the smallest size, then name, wins.  Where the margin to another is narrow, the text
is rejected.  Lines that occur in the samples of several languages
(licences, addresses) say nothing about a language and stay out of the dictionaries.

The dictionaries are the only thing fitted: per language, the texts of at most `sample` labelled documents (those
with the smallest hash of their id, over all documents of the language), `share` characters of each at most, so that
the model has at most sample * share characters a language.  Every language is learned, however many there are: the
whole model has at most `MODEL` characters, and beyond so many languages each has its equal part of them.  Prediction
covers every whole text.

Defined results: a null text, or one without a letter (numerals such as a half are none), is `und` with score 0 and
rejected; with no labelled document every text is `und`; with one language, that one with score 1; of equal sizes the
first name wins and is rejected; repeated rows are predicted alike, and learned once; an empty table gives none; only
the id, text and language columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks

RESULT = "doc_id long, lang_pred string, score double, margin long, rejected boolean"
#: Bounds of the fitted sample: documents a language, and characters of each.
SAMPLE, SHARE = 256, 1500
#: Bound of the model, which goes to every task, in characters, and the least of a document that is worth a place.
MODEL, LEAST = 32_000_000, 64
LEVEL = 15
#: Sizes within so many bytes, or this share of the smallest, are a narrow margin.
NARROW_BYTES, NARROW = 4, 0.005
#: Bytes of a piece.
PIECE = 8192
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def fit(docs: DataFrame, sample: int = SAMPLE, share: int = SHARE) -> dict[str, str]:
    """Dictionary text by language, from the documents with text and lang."""
    known = docs.where("lang is not null and text is not null and text <> ''").select("lang", "doc_id", "text")
    part = MODEL // max(1, known.select("lang").distinct().count())  # characters a language
    sample = min(sample, max(1, part // LEAST))
    share = max(1, min(share, part // sample))
    picked = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumns({"s": F.pmod("h", F.lit(4)), "t": F.pmod("h", F.lit(64))})
    for key in (["lang", "s", "t"], ["lang", "s"], ["lang"]):  # a language that most rows have is cut down in parts first
        picked = picked.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id"))).where(F.col("r") <= sample)
    ids = picked.select("lang", "doc_id").distinct()
    # at most MODEL / LEAST ids; each gives at most `share` characters, once
    texts = known.join(F.broadcast(ids), [known["lang"] == ids["lang"], known["doc_id"].eqNullSafe(ids["doc_id"])], "left_semi")
    texts = texts.groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, share)).alias("t"))
    rows = texts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "t"))).alias("all")).collect()
    lines = {r["lang"]: [line for x in reversed(r["all"]) for line in x["t"].split("\n")] for r in rows}
    shared = Counter(line for own in lines.values() for line in set(own))
    return {lang: " ".join(w for line in own if shared[line] == 1 for w in words_of(line)) for lang, own in lines.items()}


@lru_cache(maxsize=2)
def compressors(model: tuple[tuple[str, str], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, text in model:
        own = zstandard.ZstdCompressionDict(text.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=LEVEL)
        bare = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)
        out.append((lang, bare))
    return out


def decide(text: str | None, model: list[tuple[str, zstandard.ZstdCompressor]], narrow: float) -> tuple[str, float, int, bool]:
    """Language, score, margin in bytes, and whether it is rejected.

    The score is the margin's share of the second-best size, so 0 is undecided.
    """
    words = words_of(text) if text is not None and model else []
    if not any(c.isalpha() for w in words for c in w):
        return "und", 0.0, 0, True
    if len(model) == 1:
        return model[0][0], 1.0, 0, False
    data = " ".join(words).encode("utf-8", "surrogatepass")
    pieces = [data[a : a + PIECE] for a in range(0, len(data), PIECE)]
    sizes = [sum(len(c.compress(x)) for x in pieces) for _, c in model]
    best, second = sorted(sizes)[:2]
    pick = min(range(len(sizes)), key=lambda i: (sizes[i], model[i][0]))
    return model[pick][0], (second - best) / second, second - best, second <= best + max(NARROW_BYTES, narrow * best)


def predict(docs: DataFrame, model: dict[str, str], narrow: float = NARROW) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected for every document."""
    pairs = tuple(sorted(model.items()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = compressors(pairs)
        for pdf in chunks(batches, 4_000_000):
            rows = [decide(t, own, narrow) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "margin", "rejected"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"score": np.float64, "margin": np.int64})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, RESULT)


def accepted(docs: DataFrame, model: dict[str, str], narrow: float = NARROW) -> DataFrame:
    """The rows of `docs`, all columns, whose language is not rejected; decided row by row, so repeated ids are safe."""
    pairs = tuple(sorted(model.items()))

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        own = compressors(pairs)
        return pd.Series([not decide(t, own, narrow)[3] for t in text], dtype=bool)

    return docs.where(good(docs["text"]))
