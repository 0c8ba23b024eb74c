"""Token counts through a digest cache.

A count depends only on a text and on a tokenizer's file, so the cache maps
(digest of the content, digest of the tokenizer file) to a count. Distinct
digests that the cache lacks are encoded once each and appended.

Edge cases: a null text counts as the empty text (0 tokens); repeated rows and
copies share one cache entry and each keeps its own output row; an empty table
gives an empty result and leaves the cache as it is; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialseg.runtime import cut

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
#: Distinct words that a Python worker keeps the counts of.
MEMO_WORDS = 200_000
TEXTS_AT_ONCE = 256
#: Keys of 8 bytes of repeated texts that are broadcast at most.
REPEATED_KEYS = 1_000_000


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class PieceCounter:
    """Counts of a sentencepiece model, word by word where that is exact.

    No piece of a model of this kind has the space mark after another character,
    and the model does not rewrite text, so merges never cross the start of a run
    of spaces: the pieces of a text are those of its words with the spaces before
    them. Where a model does not meet both conditions, whole texts are encoded.
    """

    WORD = re.compile(r" *[^ ]+| +$")
    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        probe = " a  b\n\tc éﬁ "
        kept = "".join(self.model.encode(probe, out_type=str))
        same = all(x in kept for x in ("▁▁a", "▁▁b", "é", "ﬁ")) and kept.endswith(self.MARK)
        self.by_word = same and all(self.MARK not in p.lstrip(self.MARK) for p in pieces)
        self.memo: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.encode(texts)
        # the model puts one space mark before a text; a text that holds the mark itself is left whole
        whole = [i for i, t in enumerate(texts) if self.MARK in t]
        words = [self.WORD.findall(" " + t) if t and self.MARK not in t else [] for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        new = list({w for ws in words for w in ws if w not in memo})
        memo.update(zip(new, self.encode([w[1:] for w in new]), strict=True))
        memo[" "] = 1  # a last single space is one piece
        out = [sum(map(memo.__getitem__, ws)) for ws in words]
        for i, n in zip(whole, self.encode([texts[i] for i in whole]), strict=True):
            out[i] = n
        return out


class JsonCounter:
    """Counts of a tokenizers .json file."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]


_COUNTERS: dict[str, object] = {}


def counter(path: str):
    """The worker's counter for a tokenizer file, loaded once."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path) if path.endswith(".model") else JsonCounter(path)
    return _COUNTERS[path]


def content_digest(text):
    """Digest of normalised content: null is the empty text, and nothing else may be changed without changing counts."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def encode_misses(misses: DataFrame, model_path: str) -> DataFrame:
    """(digest, text) -> (digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for b in batches:
            n: list[int] = []
            for i in range(0, b.num_rows, TEXTS_AT_ONCE):
                n += count(b.column("text").slice(i, TEXTS_AT_ONCE).to_pylist())
            yield pa.record_batch([b.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def first_of_digest(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("digest").agg(F.first("text").alias("text"))


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """(digest, text), each digest once.

    Texts that occur once stay where they are read; only those whose short key
    occurs again are grouped. Where the repeated keys are too many to broadcast,
    all texts are grouped.
    """
    short = F.xxhash64("digest").alias("short")
    repeated = cut(keyed.groupBy(short).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("short"), "repeated")
    if repeated.limit(REPEATED_KEYS + 1).count() > REPEATED_KEYS:
        return first_of_digest(keyed)
    keys, texts = F.broadcast(repeated), keyed.withColumn("short", short)
    once, again = texts.join(keys, "short", "left_anti"), texts.join(keys, "short", "left_semi")
    return once.select("digest", "text").unionByName(first_of_digest(again))


def token_counts(docs: DataFrame, model_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit. Appends what was missing to the table at ``cache_path``."""
    spark = docs.sparkSession
    version = tokenizer_version(model_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").partitionBy("tokenizer").parquet(cache_path)

    def cached() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # runs that overlap may append the same entry

    keyed = docs.select(content_digest(F.col(text_col)).alias("digest"), text.alias("text"))
    known = cached()
    if not known.isEmpty():
        keyed = keyed.join(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "digest", "left_semi")
        misses = first_of_digest(keyed)
    else:
        misses = distinct_texts(keyed)
    encode_misses(misses, model_path).withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)

    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), content_digest(F.col(text_col)).alias("digest"))
    return rows.join(cached(), "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
