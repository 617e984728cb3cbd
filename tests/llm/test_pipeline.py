"""Each stage of the pipeline against a plain version on its own input."""

import re
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm.quality import document_quality
from quillon.session import materialise, table


def shingles(text):
    w = text.encode().translate(bytes(range(256)).lower()).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = materialise(stage(spark, docs, sf), "test")
        seen[name] = (before, docs.collect())
        if name != "best-fit packing":
            assert docs.columns == columns

    before, after = seen["quality classifier"]
    kept = {r.doc_id for r in document_quality(table(spark, sf, "documents"), table(spark, sf, "labels")).where("kept").collect()}
    assert {r.doc_id for r in after} == kept and 0.5 * len(before) < len(after) < len(before)

    before, after = seen["exact dedup"]
    best = {}
    for r in before:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(i for _, i in best.values())

    before, after = seen["simhash near-dedup"]
    kept, sets = {r.doc_id for r in after}, {r.doc_id: shingles(r.text) for r in before}
    near = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    for i in sets:
        if i not in kept:
            assert max(near(i, j) for j in sets if j != i) >= 0.8
    assert not [(i, j) for i in kept for j in kept if i < j and near(i, j) >= 0.8]

    before, after = seen["mixing to weights"]
    copies = Counter(r.doc_id for r in after)
    assert set(copies) <= {r.doc_id for r in before} and max(copies.values()) <= 2
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(after) / words(before) - 1.5) < 0.1

    before, after = seen["best-fit packing"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in after) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in before)
    by = {}
    for r in after:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_empty_and_odd_documents(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words", "en", None, 10), (3, "some  words", "en", "a", 11), (3, "some  words", "en", "a", 11)], schema)
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = materialise(stage(spark, rows, sf), "test")
            rows.count()


#: Columns whose names the stages or their operators use themselves.
CLASHING = ["copies", "_id", "_kept", "_mixed", "_copy", "row", "k0", "kept", "component_id", "evidence", "key", "text_key", "size", "node"]


def odd(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return materialise(docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING)), "docs")


def test_repeated_rows_and_clashing_columns(spark, sf):
    """One row stays of repeated ones; texts under one id are judged each for itself; other columns come through."""
    long = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing in tall trees"
    rows = [(1, "same text", "en", "a", 9)] * 3 + [(2, "same  text", "en", "a", 10), (4, long, "en", "b", 5), (4, "quite another text", "en", "b", 5), (6, long + " again", "en", "c", 5)]
    rows += [(None, "no id", "en", None, 5)] * 2
    docs = odd(spark, rows)
    exact = materialise(corpus_pipeline.exact_dedup_stage(spark, docs, sf), "exact")
    want = [(2, "same  text"), (4, long), (4, "quite another text"), (6, long + " again"), (None, "no id")]
    assert sorted(((r.doc_id, r.text) for r in exact.collect()), key=str) == sorted(want, key=str)
    near = [(1, "same text"), (4, long), (4, "quite another text"), (None, "no id")]
    for given in (exact, docs):
        got = corpus_pipeline.simhash_stage(spark, given, sf)
        assert sorted(((r.doc_id, r.text.replace("  ", " ")) for r in got.collect()), key=str) in (sorted(near, key=str), sorted([(2, "same text"), *near[1:]], key=str))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and all(r[c] == f"own {c}" for r in out.collect() for c in CLASHING)
    assert corpus_pipeline.quality_stage(spark, docs, sf).where("doc_id = 1").count() in (0, 3)


def test_quality_judges_texts_of_one_id_apart(spark, sf):
    """Two texts under one id, of which the classifier rejects one alone."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    found = document_quality(docs, labels)
    good, bad = found.where("kept").agg(F.min("doc_id")).first()[0], found.where("p_bad > 0.999").agg(F.min("doc_id")).first()[0]
    moved = materialise(docs.withColumn("doc_id", F.when(F.col("doc_id") == bad, good).otherwise(F.col("doc_id"))), "moved")
    text = docs.where(F.col("doc_id") == good).first().text
    assert [r.text for r in corpus_pipeline.quality_stage(spark, moved, sf).where(F.col("doc_id") == good).collect()] == [text]
