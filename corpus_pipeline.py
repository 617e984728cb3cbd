"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import SPACE
from quillon.llm.exact_dedup import exact_dedup
from quillon.llm.jaccard import near_components
from quillon.llm.mixing import mix
from quillon.llm.packing import pack
from quillon.llm.quality import document_quality
from quillon.session import materialise, table

#: The stages use the language libraries and models above, which SQL cannot express.
ORACLE_SQL = None
#: Near duplicates are found first by fingerprints and sketches; links, theirs and the rest, are exact similarities of
#: five-word shingles of SIMILAR or more.
NEAR = {"n": 1, "as_set": True, "budget": 3, "seeds": (42, 43, 44), "verify": 5, "least": 0.6}
SIMILAR = 0.8


def text_key(text: Column) -> Column:
    """The SHA-256 of a text, null as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def keep_rows(docs: DataFrame, keys: list[Column], verdict: DataFrame, once: bool) -> DataFrame:
    """The rows of docs that the verdict keeps; with `once`, one row (the least) for each value of keys.

    verdict has a row (k0, k1, ..., kept) for each row of docs, equal for rows with equal keys (nulls too).  The rows of
    docs travel as one struct, so that their column names clash with nothing.
    """
    names = [f"k{i}" for i in range(len(keys))]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    count = F.count("*") > (1 if once else F.count("*"))
    other = materialise(verdict.groupBy(*names).agg(F.max("kept").alias("kept"), count.alias("several")).where("several OR NOT kept"), "other")

    def among(found: DataFrame, how: str) -> DataFrame:
        found = found.select(*(F.col(n).alias(f"_{n}") for n in names))
        same = [rows[n].eqNullSafe(found[f"_{n}"]) for n in names]
        return rows.join(found, same, how)

    kept = among(other, "left_anti").select("row")
    if once:
        repeated = among(other.where("kept"), "left_semi").groupBy(*names).agg(F.min("row").alias("row")).select("row")
        kept = kept.unionByName(repeated)
    return kept.select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what the classifier, fitted on `labels`, holds for low quality or toxic.

    Nulls and empty texts are judged like others; repeated rows stay or go together, rows of one id with different texts
    each for itself.  Columns of any other names pass through.
    """
    rows = docs.select("doc_id", "text", "source", "lang", text_key(F.col("text")).alias("key"))
    verdict = document_quality(rows, table(spark, sf_dir, "labels"), carry=("key",))
    return keep_rows(docs, [F.col("doc_id"), text_key(F.col("text"))], verdict.select(F.col("doc_id").alias("k0"), F.col("key").alias("k1"), "kept"), once=False)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, one row stays: the longest text, then the smallest id.

    Null texts count as empty and a null id loses to others; of rows that repeat that id and text one stays.
    """
    verdict = exact_dedup(docs).select(F.col("doc_id").alias("k0"), F.col("text_sha256").alias("k1"), F.col("n_chars").alias("k2"), "kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.sha2(F.regexp_replace(text, SPACE + "+", "").cast("binary"), 256)
    return keep_rows(docs, [F.col("doc_id"), plain, F.char_length(text)], verdict, once=True)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one row stays: that with the smallest id (of its texts, the one with the least hash).

    Null and blank texts are one group; null ids come last; of rows that repeat an id and text one stays.
    """
    verdict = near_components(docs, SIMILAR, **NEAR).select(F.col("doc_id").alias("k0"), F.col("text_key").alias("k1"), "kept")
    return keep_rows(docs, [F.col("doc_id").cast("long"), text_key(F.col("text"))], verdict, once=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it: not at all, once or twice.

    Rows of one id and source are taken equally often; null sources are a source, null texts have no words.
    """
    taken = mix(docs).where("copies > 0").select(F.col("doc_id").alias("k0"), F.col("source").alias("k1"), "copies").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("i"), F.col("source").alias("s"))
    rows = rows.join(taken, [rows["i"].eqNullSafe(taken["k0"]), rows["s"].eqNullSafe(taken["k1"])])
    return rows.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of sequences of at most 2,048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("mixing to weights", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs
