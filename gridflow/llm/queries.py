"""The registered queries of the thirteen operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import editprint, htmltext, kneserney, langid, lattice, lexical, licenses, lmscore, packing, periodic, sentencepiece, simhash, topk
from .common import bounded_batches, crc_fold, materialise

#: Where the public vocabularies lie; a parameter of every operator that takes one.
TOKENIZERS = os.path.dirname(public_tokenizers.__file__)


def tokenizer_path(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    crc = F.crc32(F.to_binary(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 8, "0")), ""), F.lit("hex")))
    return found.select("doc_id", "n_tokens", crc.alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), F.length("decoded").cast("long").alias("n_chars"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return kneserney.classify(table(spark, sf_dir, "documents"), trusted)


def op3_editprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialise(editprint.edits(table(spark, sf_dir, "documents")), "edits").withColumn("fp", F.unhex("fingerprint"))
    return found.join(editprint.near_table(found.select("doc_id", "fp")), "fp").drop("fp")


def op4_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), lambda doc_id: crc_fold(doc_id, 7) == 2)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs.where(crc_fold("doc_id", 4) != 2)))
    return found.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("lic_n_words").alias("n_words"), F.col("lic_n_base").alias("n_base"), F.col("lic_first").alias("first_word"), F.col("lic_last").alias("last_word"),
        F.array_join(F.array_sort("lic_base"), ",").alias("base_labels"), F.array_join("lic_labels", ",").alias("labels"), F.col("lic_score").alias("score"),
    )


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.main_text(pages, htmltext.fit(pages))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(packing.TOKENIZER))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The places of words after a run is planted in a document of n words; its id says whether, where and of which period."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % (1 + (n - a) // (3 + g % 8)))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(table(spark, sf_dir, "documents"), reword=planted)
    # lengths and periods are far below 2**26, so unequal quotients are unequal as doubles
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("times"), (-r["start"]).alias("s"), (-r["period"]).alias("q"), r.alias("r"))))["r"]
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    digest = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return digest.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality": op2_quality,
    "op3_editprint": op3_editprint,
    "op4_lmscore": op4_lmscore,
    "op5_langid": op5_langid,
    "op6_licenses": op6_licenses,
    "op7_html": op7_html,
    "op8_packing": op8_packing,
    "op9_topk": op9_topk,
    "op10_simhash": op10_simhash,
    "op11_lexical": op11_lexical,
    "op12_lattice": op12_lattice,
    "op13_periodic": op13_periodic,
}

SQL: dict[str, str] = {
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op11_lexical": r"""
        WITH t AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
        ), d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL
        ), c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d
        ), q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), w AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c WHERE term IN (SELECT term FROM q) GROUP BY term, docs
        ), s AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
            FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (doc_id), c GROUP BY ALL
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 10
    """,
    "op12_lattice": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
        ), u AS (
            SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_inner_product(e, e) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
        ), r AS (
            SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        )
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, min(b) AS component_id, vec_id = min(b) AS kept
        FROM v JOIN r ON r.a = vec_id GROUP BY vec_id
    """,
}
