"""Token counts and ids of a byte-level BPE, with overlapping chunks for huge documents."""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import table

#: Texts of more characters than this are encoded in overlapping chunks of this size.
HUGE = 32_768
OVERLAP = 512
#: A run of so many characters with or without white space is left to the library, whose merging suits long words.
LONG_RUN = 512
#: No boundary within this many characters of a chunk's cut end counts as proven; longer than any special token.
MARGIN = 64


class Encoder:
    """Ids of texts as the tokenizer at `path` gives them without added special tokens, as numpy arrays.

    If the vocabulary is a byte-level BPE without normalizer whose tokens are numbered in the order of its merges, merging
    by rank gives the same ids, so texts go through the faster rank-merging library with the same ranks.  Texts with
    characters beyond those whose classes are listed below, with special tokens or with very long words are left to the
    tokenizer's own library.
    """

    # The classes letter, number and white space among U+0000-024F and U+2000-206F.
    LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
    NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
    BLANK = r"\t-\r \x85\xa0\u2000-\u200a\u2028\u2029\u202f\u205f"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        listed = r"[^\x00-\u024f\u2000-\u206f]" + "".join("|" + re.escape(t) for t in special)
        self.unlisted, self.blanks = re.compile(listed).search, re.compile(rf"\s{{{LONG_RUN}}}").search
        a, n, s = self.LETTER, self.NUMBER, self.BLANK
        pattern = rf"'(?:[sdmt]|ll|ve|re)| ?[{a}]+| ?[{n}]+| ?[^{s}{a}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
        self.words = re.compile(pattern).findall
        self.ranked = self._by_rank(special)
        spec = json.loads(self.library.to_str())
        #: Whether words are cut looking forwards only, so that chunks can be spliced: by the pattern of byte-level pre-tokenizers.
        self.forwards = not spec.get("normalizer") and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space")

    def _by_rank(self, special: list[str]):
        """The rank-merging encoder for this vocabulary, or None if it might give other ids."""
        import tiktoken

        spec = json.loads(self.library.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if (
            model.get("type", "BPE") != "BPE" or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix")
            or model.get("continuing_subword_prefix") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space")
        ):
            return None
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = {t: i for t, i in model["vocab"].items() if t not in special}
        if merged != sorted(set(merged)) or len(merged) + 256 != len(plain):
            return None
        # byte-level vocabularies write each byte as a character: printable ones as they are, others from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in plain.items()}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.sizes = np.ones(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bool:
        return self.ranked is not None and not self.unlisted(text) and max(map(len, text.split()), default=0) < LONG_RUN and not self.blanks(text)

    def words_of(self, text: str) -> tuple[list[int], list[int], np.ndarray]:
        """(where the words of a text start, the number of each one's first id, all ids); words are encoded one by one."""
        if self._plain(text):
            ids = self.ranked.encode_to_numpy(text, disallowed_special=())
            words = self.words(text)
            starts = [0, *accumulate(map(len, words))][:-1]
            at = starts if text.isascii() else [0, *accumulate(len(w.encode()) for w in words)][:-1]
            ends = np.cumsum(self.sizes[ids])  # in bytes
            return starts, np.searchsorted(ends, np.array(at), "right").tolist(), ids
        e = self.library.encode(text, add_special_tokens=False)
        starts, firsts, last = [], [], None
        for i, ((start, _), word) in enumerate(zip(e.offsets, e.word_ids, strict=True)):
            if word is None or word != last:
                starts.append(start)
                firsts.append(i)
                last = word
        return starts, firsts, np.array(e.ids, np.uint32)

    def _short(self, text: str) -> np.ndarray:
        if self._plain(text):
            return self.ranked.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if len(text) > HUGE and self.forwards:
            return np.concatenate(list(self.spliced(text, HUGE, OVERLAP)))
        return self._short(text)

    def spliced(self, text: str, size: int, overlap: int) -> Iterator[np.ndarray]:
        """The ids of a text, taken from overlapping encoded chunks by the offsets of their words.

        The cut into words looks only forwards, so from a place where a word of the whole text starts, a chunk's words are
        those of the whole text, up to where its cut end can matter.  A start in the proven part of one chunk that is also
        a start in the next chunk is therefore a common boundary: the next chunk is proven from there on, wherever
        it began.  It is stable if both chunks also have the same ids from there to the last start that is proven in both.
        White space belongs to one word or two depending on what follows, so such a boundary must not stand after white
        space.  Without one, the next chunk begins earlier (the overlap is doubled), at last at a proven start; a chunk
        without any such start but its first is doubled itself.
        """
        begin, proven = 0, 0  # of the chunk; of its proven part
        chunk = self._chunk(text, 0, size)
        while (end := begin + size) < len(text):
            starts, firsts, ids = chunk
            first = bisect_left(starts, proven)
            last = min(bisect_right(starts, end - MARGIN) - 1, len(starts) - 3)  # the last start that is proven
            known = {starts[k]: k for k in range(first + 1, last + 1) if not text[starts[k] - 1].isspace()}
            if not known:
                begin, size = proven, size * 2
                chunk = self._chunk(text, begin, size)
                continue
            width, common = overlap, None
            while common is None:
                at = next(reversed(known)) if width > size else max(end - width, proven + 1)
                more = self._chunk(text, at, size)
                both = [(known[s], k) for k, s in enumerate(more[0]) if s in known]
                if both:
                    (a, b), (c, d) = both[0], both[-1]
                    if np.array_equal(ids[firsts[a] : firsts[c]], more[2][more[1][b] : more[1][d]]):
                        common = a
                width *= 2
            yield ids[firsts[first] : firsts[common]]
            begin, proven, chunk = at, starts[common], more
        starts, firsts, ids = chunk
        first = bisect_left(starts, proven)
        yield ids[firsts[first] if first < len(firsts) else len(ids) :]

    def _chunk(self, text: str, at: int, size: int) -> tuple[list[int], list[int], np.ndarray]:
        starts, firsts, ids = self.words_of(text[at : at + size])
        return [at + s for s in starts], firsts, ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file, which every machine has at the same path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one per row of docs.

    Whole texts, special strings as the library treats them, no added tokens.  Texts over HUGE characters are encoded in
    overlapping chunks; under a vocabulary that normalizes texts or cuts words in another way than by the byte-level
    pattern, boundaries can't be proven, so the library encodes such a text as a whole.  Null texts count as empty: 0 bytes,
    0 tokens.  Null ids and repeated rows are kept as they are; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            texts = batch.column("_text")
            sizes = [len(coder.encode(t)) for t in (x.as_py() for x in texts)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("n_bytes"), pa.array(sizes, pa.int64())], names=["_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("n_bytes"))
        .mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long")
        .select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
