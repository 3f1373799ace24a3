"""Token counts as rollups that signed changes keep up to date.

A store holds batches of signed rows. A change to a document (a new one, a revised count, a
deletion) becomes a row with the sign -1 that takes back what the store had for it, and one
with +1 for what it has now. Totals by source, language and tokenizer version are additive,
so they are sums over batches, whatever their order.

A batch is committed by its name: its folder counts once Spark's writer has left the marker
that it leaves last. A commit that failed half-way is overwritten by the next try, and a
batch that is committed is not applied again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_path

#: What a batch of changes holds. ``deleted`` true takes the document out.
CHANGES = "doc_id long, tokenizer string, source string, lang string, n_tokens long, deleted boolean"
_KEY = ["doc_id", "tokenizer"]
_GROUP = ["source", "lang", "tokenizer"]
_LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, sign int"
_SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


@dataclass
class Store:
    """Ledger and rollup below one folder that driver and executors share."""

    spark: SparkSession
    folder: str

    @classmethod
    def new(cls, spark: SparkSession) -> Store:
        return cls(spark, shared_path(spark, "rollup-"))

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        system = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return path, system

    def committed(self, kind: str = "rollup") -> list[str]:
        """Names of the batches whose folder is complete."""
        path, files = self._files()
        top = path(f"{self.folder}/{kind}")
        if not files.exists(top):
            return []
        names = [s.getPath().getName() for s in files.listStatus(top) if s.isDirectory()]
        return sorted(n.removeprefix("batch=") for n in names if files.exists(path(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def _read(self, kind: str, schema: str) -> DataFrame:
        # a batch counts when its rollup, which is written last, is complete
        paths = [f"{self.folder}/{kind}/batch={name}" for name in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes; False if it was applied before.

        Of several changes to one (document, tokenizer) in a batch the largest counts, with
        deletions last. Changes without an id or a tokenizer version are left out; a null
        count is 0. A deletion of what the store does not hold does nothing.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits, - and _")
        if batch in self.committed():
            return False
        row = F.struct(
            (~F.coalesce("deleted", F.lit(False))).alias("stays"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
            F.col("source"), F.col("lang"),
        )
        usable = changes.filter("doc_id is not null and tokenizer is not null")
        latest = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer").agg(F.max(row).alias("row"))
        latest = latest.select(*_KEY, "row.*")
        added = latest.filter("stays").select(*_KEY, "source", "lang", "n_tokens", F.lit(1).alias("sign"))
        signed = added
        if self.committed():
            held = self._read("ledger", _LEDGER).join(latest.select(*_KEY), _KEY, "left_semi")
            held = held.groupBy(*_KEY, "source", "lang", "n_tokens").agg(F.sum("sign").alias("times")).filter("times > 0")
            signed = added.unionByName(held.select(*_KEY, "source", "lang", "n_tokens", F.lit(-1).alias("sign")))
        ledger = f"{self.folder}/ledger/batch={batch}"
        signed.write.mode("overwrite").parquet(ledger)
        sums = self.spark.read.schema(_LEDGER).parquet(ledger).groupBy(*_GROUP).agg(
            F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")
        )
        sums.write.mode("overwrite").parquet(f"{self.folder}/rollup/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups without a document are left out."""
        sums = self._read("rollup", _SUMS).groupBy(*_GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0")
