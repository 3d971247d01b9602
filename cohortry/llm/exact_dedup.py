"""Exact duplicates by stateful streaming (operator 9).

A narrow record of every document (digest, identifier, locator of the content) is appended to a folder that a
streaming query reads. Its keyed state lives in RocksDB, has no watermark and never expires; for each digest it
retains the largest identifier with its locator, and the number of rows. Later batches go on from that state. Rows
whose digest was seen before are hits, and their full bytes are compared with the retained row's.

Defined results
    NULL text counts as empty. A NULL identifier is smaller than any other. Rows that agree in identifier and text
    are told apart by their locator, so exactly one row of a group is kept. An empty table gives an empty result.
    Should two texts share a digest, the rows that differ from the retained text are grouped by their full bytes.
    Columns of the input never clash: only the identifier and the text are read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, stored

# state on local disk only while a task works on it; what is retained lies in the shared folder
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
_RECORD = "digest string, id long, file string, row long"


def normalised(text: Column) -> Column:
    """NULL as empty, A to Z in lower case, nothing else changed."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Identifier, text and locator (file and row in it) of every row; a frame that is not read from files is stored first."""
    plain = lambda d: [d[id_col].cast("long").alias("id"), d[text_col].cast("string").alias("text")]
    place = lambda d: [d.metadataColumn("_metadata")["file_path"].alias("file"), d.metadataColumn("_metadata")["row_index"].alias("row")]
    try:
        return docs.select(*plain(docs), *place(docs))
    except AnalysisException:
        kept = stored(docs.select(*plain(docs)), "located")
        return kept.select("id", "text", *place(kept))


@dataclass
class Ledger:
    """A growing set of documents in a shared folder, and the state of the query that has read it."""

    spark: SparkSession
    home: str

    def absorb(self, records: DataFrame) -> None:
        """Append records (digest, id, file, row) and bring the state up to date."""
        records.write.mode("append").parquet(f"{self.home}/records")
        conf = self.spark.conf
        before = {key: conf.get(key) for key in _STATE}
        for key, value in _STATE.items():
            conf.set(key, value)
        try:
            seen = self.spark.readStream.schema(_RECORD).parquet(f"{self.home}/records")
            state = seen.groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("kept"), F.count(F.lit(1)).alias("n"))
            run = (state.writeStream.outputMode("update").format("noop").trigger(availableNow=True)
                   .option("checkpointLocation", f"{self.home}/state").start())
            run.awaitTermination()
        finally:
            for key, value in before.items():
                conf.set(key, value)

    def records(self) -> DataFrame:
        return self.spark.read.schema(_RECORD).parquet(f"{self.home}/records")

    def retained(self) -> DataFrame:
        """What the state holds: digest, keep_id, keep_file, keep_row, n."""
        held = self.spark.read.format("statestore").load(f"{self.home}/state")
        value = [F.col(f"value.`{c}`") for c in held.schema["value"].dataType.names]
        return held.select(F.col("key.digest").alias("digest"), value[0]["id"].alias("keep_id"), value[0]["file"].alias("keep_file"),
                           value[0]["row"].alias("keep_row"), value[1].alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest) -> DataFrame:
    """One row per document: id, file, row, digest, keep_id, group_size, kept."""
    spark = docs.sparkSession
    rows = located(docs, id_col, text_col)
    ledger = Ledger(spark, fresh_path(spark, "ledger"))
    ledger.absorb(rows.select(digest(normalised(F.col("text"))).cast("string").alias("digest"), "id", "file", "row"))
    held = stored(ledger.retained(), "retained")
    judged = ledger.records().join(held, "digest")
    here = F.col("file").eqNullSafe(F.col("keep_file")) & F.col("row").eqNullSafe(F.col("keep_row"))
    # full bytes, of hits only
    hits = judged.filter("n > 1").select("file", "row", "digest", here.alias("first"))
    texts = stored(rows.select("file", "row", "id", normalised(F.col("text")).alias("text")).join(hits, ["file", "row"]), "hits")
    first = texts.filter("first").select("digest", F.col("text").alias("first_text"))
    other = stored(texts.filter("NOT first").join(first, "digest").filter("text <> first_text").select("digest", "id", "file", "row", "text"), "collisions")
    out = [F.col(c) for c in ("id", "file", "row", "digest", "keep_id")]
    if other.isEmpty():
        return judged.select(*out, F.col("n").alias("group_size"), here.alias("kept"))
    lost = other.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    same = judged.join(other.select("file", "row"), ["file", "row"], "left_anti").join(lost, "digest", "left").select(
        *out, (F.col("n") - F.coalesce("lost", F.lit(0))).alias("group_size"), here.alias("kept"))
    by_text = other.groupBy("digest", "text").agg(F.max(F.struct("id", "file", "row")).alias("k"), F.count(F.lit(1)).alias("group_size"))
    apart = other.join(by_text, ["digest", "text"]).select(
        "id", "file", "row", "digest", F.col("k.id").alias("keep_id"), "group_size",
        ((F.col("file") == F.col("k.file")) & (F.col("row") == F.col("k.row"))).alias("kept"))
    return same.unionByName(apart)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows with the input's columns."""
    spark, names = docs.sparkSession, docs.columns
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        docs = stored(docs, "documents")
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("doc"), docs.metadataColumn("_metadata")["file_path"].alias("file"),
                        docs.metadataColumn("_metadata")["row_index"].alias("row"))
    gone = stored(exact_dedup(docs, id_col, text_col).filter("NOT kept").select("file", "row"), "dropped")
    return whole.join(gone, ["file", "row"], "left_anti").select("doc.*")
