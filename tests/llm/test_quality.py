import math

import pytest
from pyspark.sql import functions as F

from quillon.llm.quality import classify, document_quality


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    found = document_quality(docs, labels.where(~held)).join(labels.where(held), "doc_id")
    got = {(r.quality, r.toxic): r.share for r in found.groupBy("quality", "toxic").agg(F.avg((~F.col("kept")).cast("int")).alias("share")).collect()}
    assert got[1, 0] <= 0.01 and got[0, 0] >= 0.9 and got[0, 1] >= 0.85 and got[1, 1] >= 0.85


def brute_rates(rows):
    """For each (host, path, evidence) row the rates (overall, host, path) among the other rows."""

    def strength(groups):
        n = sum(g[1] for g in groups)
        between = sum(g[1] * (g[0] / g[1] - g[2]) ** 2 for g in groups)
        sampling = sum(g[2] * (1 - g[2]) for g in groups)
        unit = sum(g[1] * g[2] * (1 - g[2]) for g in groups) / n
        return min(max(unit / max((between - sampling) / n, 1e-12) - 1, 2.0), 1e6)

    def held(key):
        out = {}
        for row in rows:
            out.setdefault(key(row), []).append(row[2])
        return out

    hosts, paths = held(lambda r: r[0]), held(lambda r: r[:2])
    overall = sum(e for *_, e in rows) / len(rows)
    k = strength([(sum(v), len(v), overall) for v in hosts.values()])
    rate = {h: (sum(v) + k * overall) / (len(v) + k) for h, v in hosts.items()}
    kp = strength([(sum(v), len(v), rate[h]) for (h, _), v in paths.items()])
    found = []
    for h, p, e in rows:
        rest = (sum(x for *_, x in rows) - e) / (len(rows) - 1)
        host = (sum(hosts[h]) - e + k * rest) / (len(hosts[h]) - 1 + k)
        found.append((rest, host, (sum(paths[h, p]) - e + kp * host) / (len(paths[h, p]) - 1 + kp)))
    return found


def test_posteriors_against_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = document_quality(docs, labels).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    logit = lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    for r, (overall, host, path) in zip(found, brute_rates([(r.source, r.lang, r.evidence) for r in found]), strict=True):
        p = 1 / (1 + math.exp(-(logit(r.evidence) + logit(path) - logit(overall))))
        assert (r.host_rate, r.path_rate, r.p_bad) == pytest.approx((host, path, p), rel=1e-6) and r.kept == (r.p_bad < 0.5)


def test_own_evidence_does_not_count_twice(spark):
    """A document alone at its host and path keeps its own evidence, but for what other hosts' documents say."""
    rows = [(i, f"word{i % 7} " * 20 + ("junk" if i % 2 else "fine"), f"host{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, bad int")
    for r in classify(docs, labels, F.col("source"), F.col("source")).collect():
        assert r.p_bad == pytest.approx(r.evidence, abs=1e-6) and r.kept == (r.doc_id % 2 == 0)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "fine words " * 300_000), (2, None)], "doc_id long, text string").withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, bad int")
    assert classify(docs, labels, F.col("source"), F.col("source")).count() == 2


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (2, "a b", "s", 1), (2, "a b", "s", 1), (None, "", "t", 1)], "doc_id long, text string, source string, evidence int")
    labels = spark.createDataFrame([(1, 0), (9, 1), (None, 1), (2, None)], "doc_id long, bad int")
    rows = classify(docs, labels, F.col("source"), F.col("source")).collect()
    assert len(rows) == 4 and all(r.evidence == 0 and r.kept for r in rows)
    assert classify(docs, labels.limit(0), F.col("source"), F.col("source")).count() == 4
    assert classify(docs.limit(0), labels, F.col("source"), F.col("source")).count() == 0
