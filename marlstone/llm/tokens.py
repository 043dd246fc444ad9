"""Token counts: rollups kept by signed deltas, in batches that are committed once.

Totals by source, language and tokenizer version are additive, so a batch of changes is reduced to signed sums before it
is written: an insert adds a document and its tokens, a delete takes them away, a revision takes the old count from the old
key and adds the new one to the new key. A batch is written aside and published by one rename; a batch id that is already
published is not written again, so a batch can be replayed after any failure. ``compact`` folds published batches into a
base that remembers their ids; a batch that is published meanwhile stays a batch of its own, and one whose id the new base has is
not counted again, whoever publishes it. State lies in the shared folder and is read through Spark only.

Nulls: null sources, languages and versions are keys of their own; a null count is 0; a change without an op is none. Repeated
change rows count each. Any text is a batch id, the empty one too. Empty batches are committed too; an empty table has no totals.
Texts are counted whole, however long. Extra columns are ignored. Keys whose documents and tokens are all zero are not reported.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, importable, materialize

KEYS = ("source", "lang", "tokenizer")
#: Fixed value: how the vocabulary's tokenizer cuts a text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """A byte-level BPE encoder of a vocabulary of ranks; one for each worker process."""
    import tiktoken

    name = xxhash.xxh3_128_hexdigest(vocabulary + pattern.encode())
    if name not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


class Rollup:
    """Totals below the folder ``root``: batches/<id>/data and base/<n>/{totals,ids}."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        fs, at = file_system(self.spark, f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _publish(self, df_by_part: dict[str, DataFrame], folder: str) -> bool:
        """Writes aside and renames; whether this call published it."""
        fs, at = file_system(self.spark, f"{self.root}/{folder}")
        if fs.exists(at):
            return False
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        for part, df in df_by_part.items():
            df.write.parquet(f"{aside}/{part}")
        fs.mkdirs(at.getParent())
        _, source = file_system(self.spark, aside)
        # Of two that race, the loser's rename fails or lands below the winner's folder, where nothing looks.
        done = fs.rename(source, at)
        _, below = file_system(self.spark, f"{self.root}/{folder}/{source.getName()}")
        return bool(done) and not fs.exists(below)

    @staticmethod
    def deltas(changes: DataFrame) -> DataFrame:
        """``changes``: op (insert, delete, revise), source, lang, tokenizer, n_tokens; a revision also old_n_tokens and,

        where the key changed, old_source, old_lang, old_tokenizer (columns that are missing: as before).
        """
        n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
        old_n = F.coalesce(F.col("old_n_tokens"), F.lit(0)).cast("long") if "old_n_tokens" in changes.columns else F.lit(0).cast("long")
        old = [F.col(f"old_{k}" if f"old_{k}" in changes.columns else k).alias(k) for k in KEYS]
        new = [F.col(k) for k in KEYS]
        row = lambda keys, docs, tokens: F.struct(*keys, F.lit(docs).cast("long").alias("n_docs"), tokens.alias("n_tokens"))
        op = F.col("op")
        signed = (F.when(op == "insert", F.array(row(new, 1, n))).when(op == "delete", F.array(row(new, -1, -n)))
                  .when(op == "revise", F.array(row(old, -1, -old_n), row(new, 1, n))).when(op.isNull(), F.slice(F.array(row(new, 0, n)), 1, 0))
                  .otherwise(F.raise_error(F.concat(F.lit("unknown change: "), op))))
        return changes.select(F.explode(signed).alias("x")).select("x.*").groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; False and no change if it was committed before."""
        name = "b" + base64.urlsafe_b64encode(batch_id.encode()).decode()
        if name in self._folded():
            return False
        return self._publish({"data": self.deltas(changes)}, f"batches/{name}")

    def _base(self) -> int:
        return max((int(x) for x in self._names("base")), default=0)

    def _folded(self) -> set[str]:
        n = self._base()
        return {r[0] for r in self.spark.read.parquet(f"{self.root}/base/{n}/ids").collect()} if n else set()

    def _parts(self) -> tuple[list[str], list[str]]:
        """Folders of sums, and the batches among them."""
        n, folded = self._base(), self._folded()
        open_ = [b for b in self._names("batches") if b not in folded]
        return [f"{self.root}/base/{n}/totals"] * bool(n) + [f"{self.root}/batches/{b}/data" for b in open_], sorted(folded | set(open_))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        parts, _ = self._parts()
        schema = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
        if not parts:
            return self.spark.createDataFrame([], schema)
        sums = self.spark.read.schema(schema).parquet(*parts).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> bool:
        """Folds what is committed into a new base, then drops the batches that it holds."""
        parts, ids = self._parts()
        if not parts:
            return False
        done = self._publish({"totals": self.totals(), "ids": self.spark.createDataFrame([(i,) for i in ids], "id string")}, f"base/{self._base() + 1}")
        for b in ids if done else []:
            fs, at = file_system(self.spark, f"{self.root}/batches/{b}")
            fs.delete(at, True)
        return done


def counted(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", pattern: str = PATTERN) -> DataFrame:
    """Per row: doc_id, source, lang, copy (128-bit hash of the text), guess (a token for four bytes), words, tokens."""
    importable(docs.sparkSession)
    if not Path(vocabulary).is_file():
        raise FileNotFoundError(f"no vocabulary of ranks at {vocabulary}")
    shipped = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a vocabulary: about a megabyte
    kind = docs.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shipped.value, pattern).encode_ordinary
        for batch in batches:
            copy, guess, words, tokens = [], [], [], []
            for t in batch.column(3).to_pylist():
                raw = (t or "").encode("utf-8", "replace")
                copy.append(xxhash.xxh3_128_digest(raw))
                guess.append(-(-len(raw) // 4))
                words.append(len(raw.split()))
                tokens.append(len(encode(t)) if t else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(copy, pa.binary()), *(pa.array(x, pa.int64()) for x in (guess, words, tokens))], names=["doc_id", "source", "lang", "copy", "guess", "words", "tokens"])

    cols = [F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")]
    return docs.select(*cols).mapInArrow(count, f"doc_id {kind}, source string, lang string, copy binary, guess bigint, words bigint, tokens bigint")


def corpus_totals(docs: DataFrame, vocabulary: str, root: str, version: str = "byte_bpe_50k", copies: bool = False) -> DataFrame:
    """Totals of a corpus as its batches leave them below ``root``, which is the caller's to keep.

    Batch ``load`` inserts every document with its words and, for the BPE tokenizer, a guess from its bytes; ``exact``
    revises the guesses to the tokenizer's counts; ``copies`` deletes all but the least id of equal texts, and, with ``copies``, batch
    ``all`` inserts those again, so that every row counts; then all are sent once more, without effect.
    """
    known = materialize(counted(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), "counted")
    versions = lambda df, bpe: df.select("source", "lang", F.explode(F.array(F.struct(F.lit("words").alias("tokenizer"), F.col("words").alias("n_tokens")), F.struct(F.lit(version).alias("tokenizer"), F.col(bpe).alias("n_tokens")))).alias("x")).select("source", "lang", "x.*")
    stays = known.groupBy("copy").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("least")).select(F.col("least.row").alias("stay"))
    surplus = known.join(stays, F.col("row") == F.col("stay"), "left_anti")
    batches = {
        "load": versions(known, "guess").withColumn("op", F.lit("insert")),
        "exact": known.select("source", "lang", F.lit(version).alias("tokenizer"), F.col("tokens").alias("n_tokens"), F.col("guess").alias("old_n_tokens"), F.lit("revise").alias("op")),
        "copies": versions(surplus, "tokens").withColumn("op", F.lit("delete")),
    }
    if copies:
        batches["all"] = versions(surplus, "tokens").withColumn("op", F.lit("insert"))
    rollup = Rollup(docs.sparkSession, root)
    for _ in range(2):
        for name, changes in batches.items():
            rollup.commit(name, changes)
    return rollup.totals()
