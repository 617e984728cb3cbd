"""Fill-in-the-middle over line boundaries, with cuts looked up in a piecewise-linear learned rank index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import table

#: A segment's line stays within so many characters of every boundary; residuals then fit a signed byte.
ERROR = 126
#: The sentinels of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Boundaries that the fit looks at first in a segment; doubled while they fit.
AHEAD = 32
INDEX = "struct<n:long,ranks:array<int>,bases:array<long>,slopes:array<double>,residuals:binary>"


def boundaries(text: str) -> np.ndarray:
    """0 and the end of each line `[^\\n]*\\n|[^\\n]+` of a text, in code points."""
    units = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(units == 10) + 1
    rest = [len(units)] if len(units) and units[-1] != 10 else []
    return np.concatenate([[0], ends, rest]).astype(np.int64)


def fit(offsets: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first rank, base, slope) of each segment and the residuals of all ranks.

    A segment grows while some slope through its first point stays within `error` of all its points: the cone of such
    slopes narrows from point to point, and the point that would close it starts the next segment.
    """
    n, i = len(offsets), 0
    ranks, slopes = [], []
    while i < n:
        least, most, j, step = -np.inf, np.inf, i + 1, AHEAD
        while j < n:
            k = min(n, j + step)
            run, rise = np.arange(j - i, k - i), offsets[j:k] - offsets[i]
            low = np.maximum(np.maximum.accumulate((rise - error) / run), least)
            high = np.minimum(np.minimum.accumulate((rise + error) / run), most)
            closed = np.flatnonzero(low > high)
            fits = int(closed[0]) if len(closed) else k - j
            if fits:
                least, most = low[fits - 1], high[fits - 1]
            j, step = j + fits, step * 2
            if len(closed):
                break
        ranks.append(i)
        slopes.append((least + most) / 2 if j > i + 1 else 0.0)
        i = j
    first, slope = np.array(ranks, np.int64), np.array(slopes)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    residuals = offsets - _line(offsets[first][of], slope[of], np.arange(n) - first[of])
    return first, offsets[first], slope, residuals.astype(np.int8)


def _line(base: np.ndarray, slope: np.ndarray, run: np.ndarray) -> np.ndarray:
    return base + np.rint(slope * run).astype(np.int64)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def _indexes(texts: list[str], error: int) -> pa.StructArray:
    found = [boundaries(t) for t in texts]
    fitted = [fit(b, error) for b in found]
    parts = [[f[i] for f in fitted] for i in range(3)]
    columns = [
        pa.array([len(b) - 1 for b in found], pa.int64()), _lists(parts[0], pa.int32()), _lists(parts[1], pa.int64()), _lists(parts[2], pa.float64()),
        pa.array([f[3].tobytes() for f in fitted], pa.binary()),
    ]
    return pa.StructArray.from_arrays(columns, names=["n", "ranks", "bases", "slopes", "residuals"])


def look_up(index: pa.StructArray, ranks: np.ndarray) -> np.ndarray:
    """The offset of one boundary of each row: predicted by the segment that covers its rank, corrected by its residual."""
    starts = index.field("ranks")
    begin = starts.offsets.to_numpy()
    row = np.arange(len(index))
    key = np.repeat(row, np.diff(begin)) << 32 | starts.values.to_numpy()[begin[0] : begin[-1]]
    at = np.searchsorted(key, row << 32 | ranks, "right") - 1 + begin[0]
    base, slope, first = (index.field(c).values.to_numpy()[at] for c in ("bases", "slopes", "ranks"))
    held = index.field("residuals")
    places = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    residuals = np.frombuffer(held.buffers()[2], np.int8)[places[:-1] + ranks] if len(row) else np.empty(0, np.int8)
    return _line(base, slope, ranks - first) + residuals


def rank_indexed(docs: DataFrame, text_col: str, name: str = "_index", error: int = ERROR) -> DataFrame:
    """docs with a column `name`: the learned index over the line boundaries of the text, by rank from 0 to n.

    Segments (first rank, offset there, slope) predict each boundary within `error` (at most 126) characters, and a signed
    byte per boundary corrects the prediction exactly, so a column of boundaries takes about a byte a line instead of
    eight.  It can be stored with the documents, and each epoch's cuts be looked up without scanning the texts again.
    """
    if not 0 <= error <= 126:
        raise ValueError("residuals beyond 127 don't fit a byte")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _indexes(texts, error)], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{name}` {INDEX}")


def _cut(marks: tuple[str, str, str]):
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.column("_index")
            a, b = (look_up(index, batch.column(c).to_numpy()) for c in ("_a", "_b"))
            out = []
            for text, form, i, j in zip(batch.column("_text").to_pylist(), batch.column("form").to_pylist(), a.tolist(), b.tolist(), strict=True):
                if form == "psm":
                    text = f"{p}{text[:i]}{s}{text[j:]}{m}{text[i:j]}"
                elif form == "spm":
                    text = f"{s}{text[j:]}{p}{text[:i]}{m}{text[i:j]}"
                out.append(text)
            plain = np.array(batch.column("form").to_numpy(zero_copy_only=False) == "plain", bool)
            sizes = [pa.array(x, pa.int64(), mask=plain) for x in (a, b - a)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), index.field("n"), batch.column("form"), *sizes, pa.array(out, pa.string())],
                names=["_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(
    docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text", error: int = ERROR
) -> DataFrame:
    """Rows (id, n, form, prefix_chars, middle_chars, output), one per row of docs: texts cut at two of their n + 1 line
    boundaries and put together anew, in `rate` of 100 cases, of those `spm` of 100 with the suffix first.

    The cuts and the form come from the SHA-256 of seed and id, so reruns agree, whatever the partitioning.  Texts that hold
    a sentinel stay plain, like empty ones; null texts count as empty.  A null id is hashed as no digits.  Repeated rows
    are cut alike.  Texts without a newline have the boundaries 0 and their end; very long ones are indexed whole, one at a
    time.  Other columns, whatever their names, are ignored.  No rows give no rows.
    """
    overlap = any(x != y and x in y or any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)))) for x in marks for y in marks)
    if overlap or "" in marks or len(set(marks)) < len(marks):
        raise ValueError(f"sentinels that can overlap can't be told apart: {marks}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    cuts = [F.pmod(h[i], F.col("_index.n") + 1) for i in (0, 1)]
    plain = (F.col("_text") == "") | (F.pmod(h[2], F.lit(100)) >= rate)
    for mark in marks:
        plain |= F.contains("_text", F.lit(mark))
    form = F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < spm, "spm").otherwise("psm")
    indexed = rank_indexed(docs.select(F.col(id_col).alias("_id"), text.alias("_text")), "_text", error=error)
    dealt = indexed.select("_id", "_text", "_index", F.least(*cuts).alias("_a"), F.greatest(*cuts).alias("_b"), form.alias("form"))
    kind = docs.schema[id_col].dataType.simpleString()
    return dealt.mapInArrow(_cut(marks), f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that fill_in_middle made an output of, from the output and its form alone."""
    p, s, m = marks
    at = {x: F.locate(x, output) for x in marks}
    between = lambda x, y: output.substr(at[x] + len(x), at[y] - at[x] - len(x))
    middle = output.substr(at[m] + len(m), F.char_length(output))
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
