"""Substring dedup: matching statistics of documents against suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import salted_left_join
from quillon.session import materialise, table

WINDOW, GRAM = 50, 20
#: Different passages around one anchor that a single automaton may hold at most; windows of larger shards are grouped instead.
LARGE_SHARD = 2_000
#: Words that it may hold.
LARGE_WORDS = 400_000
#: Windows held at once while large shards are cut into them.
BLOCK = 20_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            factors = np.full(2 * n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def anchors(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The anchor of each window: the least hash of its grams."""
    if len(words) < window:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    up, down = powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * down[:-1], dtype=np.uint64)])
    grams = mixed((sums[gram:] - sums[:-gram]) * up[: len(words) - gram + 1])
    w = window - gram + 1
    padded = np.concatenate([grams, np.full(-len(grams) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    from_left = np.minimum.accumulate(padded, axis=1).ravel()
    from_right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_right[: len(grams) - w + 1], from_left[w - 1 : len(grams)])


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(values)]])


class Automaton:
    """A generalised suffix automaton over words; each state knows the least document in which its words occur."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.length, self.link, self.least = [0], [-1], [None]

    def _state(self, length: int, moves: dict, link: int, least) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.least.append(least)
        return len(self.length) - 1

    def add(self, words: list, document: int) -> None:
        """Documents must be added in ascending order."""
        following, length, link = self.next, self.length, self.link
        last = 0
        for w in words:
            at = following[last].get(w)
            if at is not None and length[at] == length[last] + 1:
                last = at
                continue
            now = self._state(length[last] + 1, {}, 0, document) if at is None else None
            p = last
            while p >= 0 and at is None and w not in following[p]:
                following[p][w] = now
                p = link[p]
            if p < 0:
                last = now
                continue
            q = following[p][w]
            if length[q] == length[p] + 1:
                if now is not None:
                    link[now] = q
                last = now if now is not None else q
                continue
            clone = self._state(length[p] + 1, dict(following[q]), link[q], self.least[q])
            while p >= 0 and following[p].get(w) == q:
                following[p][w] = clone
                p = link[p]
            link[q] = clone
            if now is not None:
                link[now] = clone
            last = now if now is not None else clone

    def finish(self) -> None:
        """Hands each state's least document up its suffix links."""
        least, link = self.least, self.link
        for s in sorted(range(1, len(link)), key=lambda s: -self.length[s]):
            p = link[s]
            if p > 0 and (least[p] is None or least[s] < least[p]):
                least[p] = least[s]

    def earlier(self, words: list, document: int, window: int) -> list[int]:
        """Starts of the windows of `words` that occur in a document smaller than `document`."""
        following, length, link, least = self.next, self.length, self.link, self.least
        found, state, size = [], 0, 0
        for i, w in enumerate(words):
            while state and w not in following[state]:
                state = link[state]
                size = length[state]
            if w in following[state]:
                state = following[state][w]
                size += 1
            while state and length[link[state]] >= window:
                state = link[state]
                size = length[state]
            if size >= window and least[state] < document:
                found.append(i - window + 1)
        return found


def _ranges(starts: list[int]) -> list[int]:
    """Sorted starts as a flat list of ranges (from, to, from, to ...)."""
    out: list[int] = []
    for s in starts:
        if out and out[-1] == s:
            out[-1] = s + 1
        else:
            out += [s, s + 1]
    return out


def _words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").split()


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _anchor_lists(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(anchors(_words(t.as_py()), window, gram)).view(np.int64) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), pa.array(found, pa.list_(pa.int64()))], names=["doc", "th", "anchors"])

    return run


PIECE = pa.struct([("anchor", pa.int64()), ("key", pa.binary()), ("start", pa.int32()), ("n", pa.int32())])


def _pieces(window: int, gram: int):
    """Per document: word count; without repeated anchors its digest, else its text and the pieces around those anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts, pieces = [], [], [], []
            for text, repeated in zip(batch.column("text").cast(pa.binary()), batch.column("repeated"), strict=True):
                raw = text.as_py()
                words = _words(raw)
                counts.append(len(words))
                if not repeated.is_valid:
                    digests.append(_digest(words))
                    texts.append(None)
                    pieces.append(None)
                    continue
                least = anchors(words, window, gram)
                start, end = runs(least)
                keep = np.isin(least[start], repeated.values.to_numpy().view(np.uint64))
                start, end = start[keep], end[keep]
                last = end + window - 1  # words of the piece: all that its windows hold
                keys = [hashlib.sha256(b" ".join(words[a:b])).digest()[:16] for a, b in zip(start.tolist(), last.tolist(), strict=True)]
                digests.append(None)
                texts.append(raw)
                rows = zip(least[start].view(np.int64).tolist(), keys, start.tolist(), (end - start).tolist(), strict=True)
                pieces.append([{"anchor": a, "key": k, "start": s, "n": n} for a, k, s, n in rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("th"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()), pa.array(pieces, pa.list_(PIECE))],
                names=["doc", "th", "n_words", "sha", "text", "pieces"],
            )

    return run


def _piece_texts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, pieces in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("pieces"), strict=True):
                words = _words(text.as_py())
                for p in pieces.as_py():
                    rows.append((p["anchor"], p["key"], doc, p["n"] + window - 1, b" ".join(words[p["start"] : p["start"] + p["n"] + window - 1])))
            c = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = {"anchor": pa.int64(), "key": pa.binary(), "doc": pa.int64(), "n": pa.int64(), "words": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds.values(), strict=True)], names=list(kinds))

    return run


def _match(window: int):
    """Per shard (consecutive rows of one anchor): the windows of each piece that an earlier document holds."""

    def shard(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        rows.sort(key=lambda r: (r[2], r[1]))
        automaton, cut = Automaton(), [r[3].split() for r in rows]
        for (_, _, doc, _), words in zip(rows, cut, strict=True):
            automaton.add(words, doc)
        automaton.finish()
        for (anchor, key, doc, _), words in zip(rows, cut, strict=True):
            if doc > rows[0][2] and (found := automaton.earlier(words, doc, window)):
                yield anchor, key, _ranges(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "doc", "words")), strict=True):
                if rows and rows[0][0] != row[0]:
                    out += shard(rows)
                    rows = []
                rows.append(row)
            yield _earlier_batch(out)
        yield _earlier_batch(list(shard(rows)))

    return run


def _earlier_batch(rows: list[tuple]) -> pa.RecordBatch:
    a, k, r = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(k, pa.binary()), pa.array(r, pa.list_(pa.int32()))], names=["anchor", "key", "ranges"])


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, k, doc, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "doc", "words")), strict=True):
                words = text.split()
                for lo in range(0, len(words) - window + 1, BLOCK):
                    at = range(lo, min(lo + BLOCK, len(words) - window + 1))
                    found = [hashlib.sha256(b" ".join(words[i : i + window])).digest() for i in at]
                    n = len(found)
                    columns = [pa.array([a] * n, pa.int64()), pa.array([k] * n, pa.binary()), pa.array([doc] * n, pa.int64()), pa.array(at, pa.int32()), pa.array(found, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "key", "doc", "at", "window"])

    return run


def _finish(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, kept_texts = [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                words = _words(text.as_py())
                drop = np.zeros(len(words), bool)
                for flat in ranges.as_py() or []:
                    for a, b in zip(flat[::2], flat[1::2], strict=True):
                        drop[a : b + window - 1] = True
                kept = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                removed.append(int(drop.sum()))
                digests.append(_digest(kept))
                if keep_text:
                    kept_texts.append(b" ".join(kept).decode("utf-8", "replace"))
            out, names = [batch.column("doc"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc", "n_words", "n_removed", "sha"]
            if keep_text:
                out, names = [*out, pa.array(kept_texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, large: int = LARGE_SHARD, words: int = LARGE_WORDS, salts: int = 8) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256), one per row of docs.

    A word is removed if a window of `window` consecutive words over it also stands in a document with a smaller id.

    Every window has an anchor, the least hash of its grams of `gram` words, so equal windows have equal anchors; only
    anchors that several documents hold matter.  Around these, documents are cut into pieces: the words of consecutive
    windows with one anchor.  Of equal pieces the smallest document's is kept as reference, so copies collapse before they
    meet; pieces are equal if 128 bits of their SHA-256 are.  The different pieces of an anchor are a shard: a suffix automaton over them, with the least document of every
    state, gives for each piece, as it is streamed through, the windows that an earlier document holds.  In all larger
    documents with a piece, all of its windows go.  A shard with more than `large` pieces or `words` words (a passage in
    ever new surroundings, long periodic texts) is not built: its windows are grouped by SHA-256 instead, with partial aggregation, to the same end.
    Automata are dealt to tasks by anchor, since sending each to all would grow with the corpus.

    Null texts have no words.  Very long texts are cut whole, one at a time.  Other columns are ignored.  Rows with a null id keep all words and remove none from others.  Rows that repeat an id do
    not remove from each other, as neither id is smaller.  No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    lists = materialise(base.where("doc IS NOT NULL").mapInArrow(_anchor_lists(window, gram), "doc long, th long, anchors array<long>"), "anchors")
    rows = lists.select("doc", "th", F.explode("anchors").alias("anchor"))
    shared = materialise(rows.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor", F.lit(True).alias("hit")), "shared")
    repeated = salted_left_join(rows, shared, ["anchor"], F.col("doc"), salts).where("hit").groupBy("doc", "th").agg(F.collect_set("anchor").alias("repeated"))
    schema = "doc long, th long, n_words long, sha string, text binary, pieces array<struct<anchor:long,key:binary,start:int,n:int>>"
    parts = materialise(base.join(repeated, ["doc", "th"], "left").select("doc", "th", "text", "repeated").mapInArrow(_pieces(window, gram), schema), "pieces")

    candidates = parts.where("sha IS NULL")
    found = candidates.select("doc", "text", "pieces").mapInArrow(_piece_texts(window), "anchor long, key binary, doc long, n long, words binary")
    different = materialise(found.groupBy("anchor", "key").agg(F.min("doc").alias("doc"), F.max("doc").alias("most"), F.min("n").alias("n"), F.any_value("words").alias("words")), "references")
    full = materialise(different.groupBy("anchor").agg(F.count("*").alias("pieces"), F.sum("n").alias("n")).where((F.col("pieces") > large) | ((F.col("n") > words) & (F.col("pieces") > 1))).select("anchor"), "full")
    shards = different.select("anchor", "key", "doc", "words")
    earlier_schema = "anchor long, key binary, ranges array<int>"
    if full.take(1):
        big = shards.join(full, "anchor", "left_semi")
        shards = shards.join(full, "anchor", "left_anti")
        windows = materialise(big.mapInArrow(_windows(window), "anchor long, key binary, doc long, at int, window binary"), "windows")
        first = windows.groupBy("window").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("window", "first")
        hits = salted_left_join(windows, first, ["window"], F.xxhash64("key", "at"), salts).where("first < doc")
        grouped = hits.groupBy("anchor", "key").agg(F.array_sort(F.collect_set("at")).alias("at"))
        others = grouped.select("anchor", "key", F.flatten(F.transform("at", lambda x: F.array(x, x + 1))).alias("ranges"))
    ordered = shards.repartition("anchor").sortWithinPartitions("anchor")
    earlier = ordered.mapInArrow(_match(window), earlier_schema)
    if full.take(1):
        earlier = earlier.unionByName(others)
    verdicts = different.drop("words", "n").withColumnRenamed("doc", "first").join(earlier, ["anchor", "key"], "left").where("most > first OR ranges IS NOT NULL")
    verdicts = materialise(verdicts.select("anchor", "key", "first", "ranges"), "verdicts")

    spots = candidates.select("doc", "th", F.explode("pieces").alias("p")).select("doc", "th", "p.*")
    judged = salted_left_join(spots, verdicts, ["anchor", "key"], F.col("doc"), salts).where("first IS NOT NULL AND (doc > first OR ranges IS NOT NULL)")
    moved = F.when(F.col("doc") > F.col("first"), F.array("start", F.col("start") + F.col("n"))).otherwise(F.transform("ranges", lambda x: x + F.col("start")))
    removal = judged.select("doc", "th", moved.alias("r")).groupBy("doc", "th").agg(F.collect_list("r").alias("ranges"))
    done = candidates.join(removal, ["doc", "th"], "left").select("doc", "n_words", "text", "ranges")
    changed = done.mapInArrow(_finish(window, False), "doc long, n_words long, n_removed long, sha string")
    same = parts.where("sha IS NOT NULL").select("doc", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha")
    return same.unionByName(changed).select(F.col("doc").alias(id_col), "n_words", "n_removed", F.col("sha").alias("kept_sha256"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS MATERIALIZED (
  SELECT doc_id, pos, md5(array_to_string(ws[pos : pos + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS pos FROM w)
), f AS (
  SELECT h, min(doc_id) AS first FROM p GROUP BY h HAVING min(doc_id) < max(doc_id)
), s AS (
  SELECT p.doc_id, list(p.pos) AS starts FROM p JOIN f ON p.h = f.h WHERE f.first < p.doc_id GROUP BY 1
), c AS (
  SELECT doc_id, unnest(starts) AS pos FROM s
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS i FROM c, (SELECT unnest(range(50)) AS k)
), kept AS (
  SELECT u.doc_id, string_agg(word, ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) u ANTI JOIN gone g ON u.doc_id = g.doc_id AND u.i = g.i
  GROUP BY 1
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (SELECT count(*) FROM gone g WHERE g.doc_id = w.doc_id) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
