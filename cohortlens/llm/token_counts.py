"""Token totals by source, language and tokenizer version, kept up to date by signed batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import shared_folder
from . import texts, tokens

GROUP = ["source", "lang", "tokenizer"]
MEASURES = ["docs", "tokens", "chars"]
BPE, WORDS = "byte_bpe_50k", "words"  # tokenizer versions counted


def counted(documents: DataFrame, json_path: str = tokens.JSON_PATH, ranks_path: str = tokens.RANKS_PATH) -> DataFrame:
    """A row per document and tokenizer version: doc_id, source, lang, tokenizer, docs (1), tokens, chars.

    Null text counts as empty: one document of no tokens.  Null source or lang is a group of its own.
    """

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, sources, langs = (batch.column(i).to_pylist() for i in range(3))
        bodies = [t or "" for t in batch.column(3).to_pylist()]
        bpe = [len(x) for x in tokens.encoder(json_path, ranks_path).encode(batch.column(3))]
        words = [len(b.split()) for b in bodies]
        n = len(ids)
        yield {
            "doc_id": ids * 2, "source": sources * 2, "lang": langs * 2, "tokenizer": [BPE] * n + [WORDS] * n,
            "docs": [1] * (2 * n), "tokens": bpe + words, "chars": [len(b) for b in bodies] * 2,
        }

    schema = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, chars long"
    return texts.map_batches(documents.select(F.col("doc_id").cast("long"), "source", "lang", "text"), kernel, schema)


def provisional(documents: DataFrame, chars_per_token: int = 4) -> DataFrame:
    """The same rows guessed from n_chars alone, to be revised when the text has been counted.

    Documents without doc_id are left to ``revise``, which adds their counts: no later batch could tell whose guess to take back.
    """
    chars = F.greatest(F.coalesce(F.col("n_chars").cast("long"), F.lit(0)), F.lit(0))
    versions = F.explode(F.array(F.lit(BPE), F.lit(WORDS))).alias("tokenizer")
    rows = documents.select(F.col("doc_id").cast("long"), "source", "lang", versions, chars.alias("chars"))
    guess = F.ceil(F.col("chars") / chars_per_token).cast("long")
    return rows.where("doc_id IS NOT NULL").select("doc_id", *GROUP, F.lit(1).cast("long").alias("docs"), guess.alias("tokens"), "chars")


class Rollup:
    """Totals in a folder all executors share.

    ``changes`` holds every batch's signed rows by document, ``deltas`` the same added up by group.  Sums are all there is,
    so a total is the sum of deltas and a document's present counts are the sum of its changes.  A batch has an id; every
    attempt to commit it writes two fresh folders, and a marker, made in one step when both are whole, names the attempt.
    The last marker of a batch counts.  An attempt that dies leaves no marker, so the batch stays as it was published before;
    committing a batch again (a retry, a second run) changes nothing.  A batch is worked out against those with smaller ids.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"

    def insert(self, batch_id: int, rows: DataFrame) -> None:
        """Add documents.  ``rows`` are per document and tokenizer, as ``counted`` gives them."""
        self._commit(batch_id, rows)

    def delete(self, batch_id: int, doc_ids: DataFrame) -> None:
        """Take documents (column doc_id) out, with whatever they count for now; unknown and null ids change nothing."""
        self._commit(batch_id, self._present(batch_id, doc_ids, -1))

    def revise(self, batch_id: int, rows: DataFrame) -> None:
        """Replace the counts of the documents in ``rows``; documents not known yet and rows without id are inserted."""
        self._commit(batch_id, self._present(batch_id, rows, -1).unionByName(rows))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, chars over all finished batches; groups that add up to nothing are left out."""
        sums = [F.sum(m).alias(m) for m in MEASURES]
        return self._read("deltas", self._finished()).groupBy(*GROUP).agg(*sums).where(" or ".join(f"{m} <> 0" for m in MEASURES))

    def _present(self, batch_id: int, doc_ids: DataFrame, sign: int) -> DataFrame:
        wanted = doc_ids.select(F.col("doc_id").cast("long")).distinct()
        earlier = self._read("changes", {b: a for b, a in self._finished().items() if b < batch_id}).join(wanted, "doc_id", "left_semi")
        sums = [(sign * F.sum(m)).alias(m) for m in MEASURES]
        return earlier.groupBy("doc_id", *GROUP).agg(*sums).where(" or ".join(f"{m} <> 0" for m in MEASURES))

    def _commit(self, batch_id: int, rows: DataFrame) -> None:
        attempt = uuid.uuid4().hex
        changes = self._path("changes", batch_id, attempt)
        rows.select("doc_id", *GROUP, *MEASURES).write.parquet(changes)
        self._sum_up(batch_id, attempt)
        self._publish(batch_id, attempt)

    def _sum_up(self, batch_id: int, attempt: str) -> None:
        changes = self.spark.read.parquet(self._path("changes", batch_id, attempt))
        changes.groupBy(*GROUP).agg(*[F.sum(m).alias(m) for m in MEASURES]).write.parquet(self._path("deltas", batch_id, attempt))

    def _publish(self, batch_id: int, attempt: str) -> None:
        version = 1 + max((v for b, v, _ in self._markers() if b == batch_id), default=0)
        path, files = self._on_files(f"{self.folder}/commits/{batch_id:012d}-{version:09d}-{attempt}")
        files.mkdirs(path)

    def _path(self, table: str, batch_id: int, attempt: str = "") -> str:
        return f"{self.folder}/{table}/batch-{batch_id:012d}-{attempt}"

    def _on_files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _markers(self) -> list[tuple[int, int, str]]:
        """(batch, version, attempt) of every published attempt, in that order."""
        path, files = self._on_files(f"{self.folder}/commits/*")
        names = [f.getPath().getName().split("-") for f in files.globStatus(path) or []]
        return sorted((int(batch), int(version), attempt) for batch, version, attempt in names)

    def _finished(self) -> dict[int, str]:
        """The attempt that counts of every batch."""
        return {batch: attempt for batch, _, attempt in self._markers()}

    def _read(self, table: str, batches: dict[int, str]) -> DataFrame:
        schema = ("doc_id long, " if table == "changes" else "") + "source string, lang string, tokenizer string, docs long, tokens long, chars long"
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._path(table, b, attempt) for b, attempt in batches.items()])
