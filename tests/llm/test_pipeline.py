"""The pipeline's stages against plain versions, and what each keeps."""

import corpus_pipeline
from gridflow.llm import kneserney, langid


def test_stages_one_after_the_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    model = langid.fit(docs)
    own = langid.compressors(tuple(sorted(model.items())))
    stages = dict(corpus_pipeline.STAGES)

    one = stages["language"](spark, docs, sf).cache()
    want = {r["doc_id"] for r in docs.collect() if not langid.decide(r["text"], own, langid.NARROW)[3]}
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == want

    two = stages["quality"](spark, one, sf).cache()
    keep = {r["doc_id"] for r in kneserney.classify(one, spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")).where("keep").collect()}
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == keep

    three = stages["near_duplicates"](spark, two, sf).cache()
    texts = {r["doc_id"]: r["text"] for r in two.collect()}
    kept = {r["doc_id"] for r in three.collect()}
    sets = {i: set(_grams(t)) for i, t in texts.items()}
    for i in texts:  # what went has a like text that stayed, or is linked to one
        if i not in kept:
            assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in texts if j != i) > 0.5
    for i in kept:  # what stayed has no copy that stayed
        assert not any(j != i and texts[j].lower().split() == texts[i].lower().split() for j in kept)

    four = stages["packing"](spark, three, sf)
    assert {r["doc_id"] for r in four.select("doc_id").distinct().collect()} == kept


def _grams(text):
    w = text.lower().split()
    return ["_".join(w[i : i + 5]) for i in range(len(w) - 4)] or ["_".join(w)]


def test_awkward_documents(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "some words here that are plain", "en", "s", 30), (3, "some words here that are plain", "en", "s", 30), (None, "no id at all here", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = out.cache()
    left = [r["doc_id"] for r in docs.collect()]
    assert left.count(3) <= 1 and None in left or not left


def test_rows_with_one_id_are_judged_each_for_itself(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    own = [r for r in docs.join(good, "doc_id").orderBy("doc_id").limit(40).collect() if r["text"]]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in own]
    one = 10**9  # no label names it
    junk = [(one, rows[0][1], rows[0][2], "s", 1000), (one, "zq#x " * 200, rows[0][2], "s", 1000), (None, "qz@@ " * 200, rows[0][2], "s", 1000), (None, rows[1][1], rows[1][2], "s", 1)]
    more = spark.createDataFrame([*rows, *junk], docs.schema)
    kept = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["quality"](spark, more, sf).collect()]
    assert (one, rows[0][1]) in kept and (None, rows[1][1]) in kept and not any(t.startswith(("zq#x", "qz@@")) for _, t in kept)
    first = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, more, sf).collect()
    texts = [(r["doc_id"], r["text"]) for r in first]
    assert [i for i, t in texts if t == rows[0][1]] == [rows[0][0]] and sum(t.startswith("zq#x") for _, t in texts) == 1 and None in [i for i, _ in texts]


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
