"""Quality classifier: document evidence with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import salted_left_join
from quillon.session import materialise, step_settings, table

#: Labelled rows that the classifier is fitted on at most: those with the least hashes of their ids.
FIT_ROWS = 8_000
#: A word counts if it stands in so many of those.
LEAST_DOCUMENTS = 5
#: ... and if it tells good and bad documents apart by so many standard errors.
LEAST_Z = 4.5
#: Each document is scored by a model that was fitted without its fold.
FOLDS = 4
#: Bounds of the estimated strength of a prior, in documents.
STRENGTH = (2.0, 1e6)
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
SYMBOLS = b"#$%&*!|<>{}[]@^~=+_\\/"
_words = re.compile(r"[^\W\d_]+").findall


def evidence_words(text: str) -> set[str]:
    """The distinct lower-cased words of a text, and one mark each for its shares of capitals, symbols and new lines and words."""
    raw = text.encode("utf-8", "surrogatepass")
    letters = len(raw) - len(raw.translate(None, LETTERS))
    upper, symbols = len(raw) - len(raw.translate(None, UPPER)), len(raw) - len(raw.translate(None, SYMBOLS))
    words, lines = _words(text.lower()), text.split("\n")
    found = set(words)
    shares = (upper / max(1, letters), symbols / max(1, len(raw)), len(set(lines)) / len(lines), len(found) / max(1, len(words)) if len(words) > 50 else 1)
    found.update(f"{name}:{int(20 * min(1.0, share))}" for name, share in zip(("capitals", "symbols", "lines", "distinct"), shares, strict=True))
    return found


def fit_weights(words: pa.ListArray, bad: np.ndarray, least_documents: int = LEAST_DOCUMENTS, least_z: float = LEAST_Z, rounds: int = 600, ridge: float = 1e-5) -> tuple[list[str], np.ndarray]:
    """A logistic regression on word presence: (vocabulary, its weights); the first word is empty and holds the intercept.

    Words enter if the shares of good and bad documents that hold them are at least least_z standard errors apart.
    """
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())
    with_bad, with_word = np.bincount(code, bad[row], len(coded.dictionary)), np.bincount(code, minlength=len(coded.dictionary))
    n_bad, n_good, share = bad.sum(), (1 - bad).sum(), with_word / len(bad)
    apart = np.abs(with_bad / n_bad - (with_word - with_bad) / n_good) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_bad + 1 / n_good))
    often = np.flatnonzero((with_word >= least_documents) & (apart >= least_z))
    place = np.full(len(coded.dictionary), -1)
    place[often] = np.arange(len(often))
    keep = place[code] >= 0
    row, col = row[keep], place[code[keep]]
    n, weight, rate = len(bad), np.zeros(len(often)), bad.mean()
    intercept, seen, seen0 = np.log(rate / (1 - rate)), np.full(len(often), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(intercept + np.bincount(row, weight[col], n))))
        slope = np.bincount(col, (p - bad)[row], len(often)) / n + ridge * weight
        seen += slope * slope
        weight -= 0.5 * slope / np.sqrt(seen)
        slope0 = (p - bad).mean()
        seen0 += slope0 * slope0
        intercept -= 0.1 * slope0 / np.sqrt(seen0)
    return ["", *coded.dictionary.take(pa.array(often)).to_pylist()], np.concatenate([[intercept], weight])


def _fit(docs: DataFrame, chosen: DataFrame) -> list[dict[str, float]]:
    """Word weights of each fold from the other folds' labelled documents, at most FIT_ROWS, one task a fold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([sorted(evidence_words(t.as_py())) for t in batch.column("_text")], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("bad"), batch.column("fold"), words], names=["bad", "fold", "words"])

    def fit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bad = rows.column("bad").to_numpy()
        if 0 < bad.sum() < len(bad):
            vocabulary, weights = fit_weights(rows.column("words").combine_chunks(), bad)
        else:  # one kind only: its share, kept away from 0 and 1
            rate = (bad.sum() + 1) / (len(bad) + 2)
            vocabulary, weights = [""], np.array([np.log(rate / (1 - rate))])
        return pa.table({"left_out": pa.array([key[0].as_py()] * len(weights), pa.int32()), "word": pa.array(vocabulary, pa.string()), "weight": weights})

    labelled = docs.join(F.broadcast(chosen), "_id").select("bad", "fold", "_text").mapInArrow(cut, "bad double, fold int, words array<string>")
    dealt = labelled.withColumn("left_out", F.explode(F.array(*map(F.lit, range(FOLDS))))).where("fold != left_out").drop("fold")
    fitted = dealt.groupBy("left_out").applyInArrow(fit, "left_out int, word string, weight double")
    weights: list[dict[str, float]] = [{"": 0.0} for _ in range(FOLDS)]
    with step_settings(docs.sparkSession):
        rows = fitted.collect()
    for r in rows:
        weights[r.left_out][r.word] = r.weight
    return weights


def _evidence(weights: list[dict[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for text, fold in zip(batch.column("_text"), batch.column("fold").to_pylist(), strict=True):
                known = weights[fold]
                scores.append(known[""] + sum(known[w] for w in sorted(evidence_words(text.as_py()) & known.keys())))
            p = 1 / (1 + np.exp(-np.clip(np.array(scores, np.float64), -30, 30)))
            kept = [c for c in batch.schema.names if c not in ("_text", "fold")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p)], names=[*kept, "evidence"])

    return run


def logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def _shrunk(groups: DataFrame) -> DataFrame:
    """Adds `rate` and the strength `k`: each group's mean of n rows with sum s, shrunk to `prior` by the strength that the spread shows.

    With m the prior and v the spread of the group means beyond what sampling explains, the strength is m(1 - m)/v - 1.
    """
    spread = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("prior"), 2)).alias("between"),
        F.sum(F.col("prior") * (1 - F.col("prior"))).alias("sampling"),
        F.sum("n").alias("rows"),
        (F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))) / F.sum("n")).alias("unit"),
    )
    excess = F.greatest((F.col("between") - F.col("sampling")) / F.col("rows"), F.lit(1e-12))
    strength = spread.select(F.least(F.greatest(F.col("unit") / excess - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias("k"))
    return groups.crossJoin(F.broadcast(strength)).withColumn("rate", (F.col("s") + F.col("k") * F.col("prior")) / (F.col("n") + F.col("k")))


def classify(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
    fit_rows: int = FIT_ROWS, cut: float = 0.5, salts: int = 16, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (id, carried columns, evidence, host_rate, path_rate, p_bad, kept), one per row of docs.

    labels has (id, bad): 1 for documents to reject.  A logistic regression on the words and the shape of a text is fitted
    on at most `fit_rows` labelled documents, once for each of FOLDS folds of ids without that fold, and gives each
    document of the fold its evidence, a probability of being bad.  Over all documents, grouped sums of the evidence give
    each host's rate of bad documents, shrunk towards the rate of all, and each path's, shrunk towards its host's; how
    strongly follows from how far the groups differ beyond chance, so sparse sites stay near the prior.  Each document
    sees the rates of the others only: its own evidence is taken out of all three sums.  The path's rate replaces the
    overall rate as its prior; documents whose posterior p_bad is `cut` or more are rejected.

    Null texts count as empty; of very long texts all words count.  Other columns, whatever their names, are ignored.  Null hosts and paths are groups of their own.  Labels without a document, with a null id
    or null label are ignored; repeated labels of an id count as bad if one does.  Without labels of both kinds the
    evidence is the share of bad ones (0 without any).  Repeated rows get equal results.  No rows give no rows.
    """
    known = labels.where("bad IS NOT NULL").groupBy(F.col(id_col).alias("_id")).agg(F.max("bad").cast("double").alias("bad")).where("_id IS NOT NULL")
    chosen = materialise(
        docs.select(F.col(id_col).alias("_id")).distinct().join(known, "_id").orderBy(F.xxhash64("_id"), "_id").limit(fit_rows), "labelled"
    )
    counts = {r.bad: r["count"] for r in chosen.groupBy("bad").count().collect()}
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col)), F.lit(FOLDS)).cast("int").alias("fold")
    kept = [F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)]
    made = docs.select(F.col(id_col).alias("_id"), *kept, key(host).alias("h"), key(path).alias("p"), fold, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if len(counts) == 2:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.drop("fold", "_text").schema)
        scored = made.mapInArrow(_evidence(_fit(made.select("_id", "fold", "_text"), chosen)), f"{kinds}, evidence double")
    else:
        scored = made.drop("fold", "_text").withColumn("evidence", F.lit(float(max(counts, default=0.0))))
    scored = materialise(scored, "evidence")

    paths = materialise(scored.groupBy("h", "p").agg(F.sum("evidence").alias("s"), F.count("*").alias("n")), "paths")
    overall = paths.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n")).withColumn("prior", F.col("all_s") / F.col("all_n"))
    hosts = paths.groupBy("h").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).crossJoin(F.broadcast(overall))
    hosts = _shrunk(hosts).select("h", F.col("s").alias("host_s"), F.col("n").alias("host_n"), F.col("k").alias("host_k"), F.col("rate").alias("host_rate"), "all_s", "all_n")
    sites = _shrunk(paths.join(hosts, "h").withColumn("prior", F.col("host_rate"))).drop("prior", "rate", "host_rate")

    def others(s: str, n: str, k: str, prior: str) -> Column:
        """A group's shrunk rate without the document's own evidence."""
        return (F.col(s) - F.col("evidence") + F.col(k) * F.col(prior)) / (F.col(n) - 1 + F.col(k))

    posterior = 1 / (1 + F.exp(-(logit(F.col("evidence")) + logit(F.col("path_rate")) - logit(F.col("overall")))))
    return (
        salted_left_join(scored, sites, ["h", "p"], F.col("_id"), salts)
        .withColumn("overall", F.when(F.col("all_n") > 1, (F.col("all_s") - F.col("evidence")) / (F.col("all_n") - 1)).otherwise(F.col("evidence")))
        .withColumn("host_rate", others("host_s", "host_n", "host_k", "overall"))
        .withColumn("path_rate", others("s", "n", "k", "host_rate"))
        .withColumn("p_bad", posterior)
        .select(F.col("_id").alias(id_col), *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)), "evidence", "host_rate", "path_rate", "p_bad", (F.col("p_bad") < cut).alias("kept"))
    )


def document_quality(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """classify() for `documents` and `labels`: low quality or toxic is bad; the source is the host, its language a path."""
    bad = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return classify(docs, bad, F.col("source"), F.concat_ws("/", "source", "lang"), carry=carry)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
