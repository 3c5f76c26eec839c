"""Token counts kept by signed deltas: additive totals by source, language and tokenizer version."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymora.llm.common import steps, stored
from kymora.llm.packing import coder

KEYS = ["source", "lang", "tokenizer"]
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Rollup:
    """A totals table in a shared folder, changed by batches that each count once, from any number of writers.

    A commit writes the summed deltas of its batch into a folder of their own (``data/attempt=...``) and then publishes them
    by one small file that bears the batch's name and holds the attempt's. Totals are the sum over published attempts, so
    batches of different writers never touch each other. Writers of one batch race for its file: one attempt is published,
    the others count nothing. What a lost driver leaves behind is an attempt without a file, or an empty file, which a retry
    fills. No step needs a folder to be renamed, so object stores will do. ``compact`` sums published attempts into a
    snapshot with the list of them; a reader takes the latest snapshot and the attempts that are not in it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._as_path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._as_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("commits", "data", "snapshots", "included", "sums"):
            self._fs.mkdirs(self._as_path(f"{self.path}/{folder}"))

    def _publish(self, file: str, attempt: str) -> bool:
        """Create ``file`` with the attempt's name, if no other writer has filled it."""
        if self._filled(file):
            return False
        path = self._as_path(f"{self.path}/{file}")
        try:
            out = self._fs.create(path, False)
        except Exception:  # another writer's file, or what a lost one left
            if self._filled(file):
                return False
            out = self._fs.create(path, True)
        out.writeBytes(attempt)
        out.close()
        return self.spark.read.text(f"{self.path}/{file}").first()[0] == attempt

    def _filled(self, file: str) -> bool:
        path = self._as_path(f"{self.path}/{file}")
        return self._fs.exists(path) and self._fs.getFileStatus(path).getLen() > 0

    @staticmethod
    def _file(batch: str) -> str:
        return f"commits/{hashlib.sha256(batch.encode()).hexdigest()}"

    def committed(self, batch: str) -> bool:
        return self._filled(self._file(batch))

    def _snapshot(self) -> tuple[int, str | None]:
        """Number and attempt of the latest snapshot."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._as_path(f"{self.path}/snapshots")) if s.getLen() > 0]
        last = max(names, default=None)
        return (int(last), self.spark.read.text(f"{self.path}/snapshots/{last}").first()[0]) if last else (0, None)

    def _published(self) -> DataFrame:
        return self.spark.read.schema("value string").text(f"{self.path}/commits").select(F.col("value").alias("attempt")).distinct()

    def _parts(self, snapshot: str | None) -> tuple[DataFrame, DataFrame]:
        """Totals of a snapshot, and the published deltas that are not in it."""
        read = self.spark.read
        fresh = self._published()
        if snapshot:
            fresh = fresh.join(read.schema("attempt string").parquet(f"{self.path}/included/{snapshot}"), "attempt", "left_anti")
        deltas = read.schema(f"{_TOTALS}, attempt string").parquet(f"{self.path}/data").join(fresh, "attempt", "left_semi").drop("attempt")
        base = read.schema(_TOTALS).parquet(f"{self.path}/sums/{snapshot}") if snapshot else self.spark.createDataFrame([], _TOTALS)
        return base, deltas

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("n_docs", "n_tokens")])
        return sums.where("n_docs != 0 or n_tokens != 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; keys whose counts are both zero are left out."""
        base, deltas = self._parts(self._snapshot()[1])
        return self._summed(base.union(deltas))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of deltas (KEYS, sign, n_tokens); whether it was new.

        sign is 1 for an insert, -1 for a delete; a revised count is a delete of the old and an insert
        of the new one. Null keys are keys of their own, a null n_tokens counts as 0, rows with a null sign as
        nothing; repeated rows count each, other columns are ignored. No deltas make a batch that changes nothing.
        """
        if self.committed(batch):
            return False
        signed = deltas.select(*[F.col(k).cast("string") for k in KEYS], F.col("sign").cast("long").alias("n_docs"), (F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
        attempt = uuid.uuid4().hex
        self._summed(signed).write.parquet(f"{self.path}/data/attempt={attempt}")
        return self._publish(self._file(batch), attempt)

    def compact(self) -> None:
        """Sum what is published into a snapshot, so that reading does not grow with the number of batches."""
        number, last = self._snapshot()
        attempt = uuid.uuid4().hex
        published = stored(self._published())
        base, _ = self._parts(last)
        fresh = published.join(self.spark.read.schema("attempt string").parquet(f"{self.path}/included/{last}"), "attempt", "left_anti") if last else published
        deltas = self.spark.read.schema(f"{_TOTALS}, attempt string").parquet(f"{self.path}/data").join(fresh, "attempt", "left_semi").drop("attempt")
        self._summed(base.union(deltas)).write.parquet(f"{self.path}/sums/{attempt}")
        published.write.parquet(f"{self.path}/included/{attempt}")
        self._publish(f"snapshots/{number + 1:010d}", attempt)


def inserts(counts: DataFrame) -> DataFrame:
    """Deltas that add each row; all columns are kept, a column ``sign`` is replaced."""
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    """Deltas that take each row away; all columns are kept, a column ``sign`` is replaced."""
    return counts.withColumn("sign", F.lit(-1))


def revisions(counts: DataFrame, revised: str) -> DataFrame:
    """Deltas that replace n_tokens by the column ``revised``; null counts as 0 on both sides."""
    return deletes(counts).unionByName(inserts(counts.withColumn("n_tokens", F.col(revised))))


def token_counts(docs: DataFrame, versions: dict[str, str | None]) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, print: one row per document and tokenizer version.

    ``versions`` names a vocabulary file for each version, or None for words between white space.
    ``print`` is the SHA-256 of the text; a null text is an empty one. No documents give no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            texts = [t or "" for t in part.column(4).to_pylist()]
            for name, path in versions.items():
                n = [len(ids) // 4 for ids in coder(path).encode(texts)] if path else [len(t.split()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([name] * len(n)), pa.array(n, pa.int64()), part.column(3)], names=["doc_id", "source", "lang", "tokenizer", "n_tokens", "print"]
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.sha2(text, 256).alias("print"), text.alias("text"))
    return rows.mapInArrow(count, "doc_id long, source string, lang string, tokenizer string, n_tokens long, print string")


def repeated_texts(counts: DataFrame) -> DataFrame:
    """The rows of ``counts`` whose text also has a smaller doc_id (null is the smallest); rows of one id stay."""
    first = stored(counts.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("first")))
    return counts.join(first, "print").where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).drop("first")
