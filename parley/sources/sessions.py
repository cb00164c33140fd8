"""Past sessions: a table of snapshots that is only ever appended to, so that a lost job leaves it whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

SUMMARY = "id string, at timestamp, removed boolean, title string, meeting_date date, duration_ms long, n_speakers int, n_actions int, low_confidence long, keywords array<string>"
SCHEMA = SUMMARY + ", snapshot string"
KEYWORDS = 5


class Sessions:
    """Sessions under a folder. Each row saves an id or removes it; an id's newest row counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _rows(self) -> DataFrame:
        made = self.spark.createDataFrame([], SCHEMA)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        there = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        return self.spark.read.schema(SCHEMA).parquet(self.root) if there else made

    def _append(self, rows: DataFrame) -> None:
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], SCHEMA).schema]).write.mode("append").parquet(self.root)

    def _current(self) -> DataFrame:
        newest = W.partitionBy("id").orderBy(F.col("at").desc(), F.col("removed").desc())
        return self._rows().withColumn("__r", F.row_number().over(newest)).where("__r = 1 and not removed").drop("__r", "removed")

    def save(self, minutes: DataFrame, name: Column | None = None) -> None:
        """Appends a snapshot of each meeting (plans.pipeline's rows) under name, its meeting_id if not given.

        Names become file names, empty ones the time of saving; a name in use gets the first number after the last used.
        """
        now = F.current_timestamp()
        base = tx.safe_name(F.coalesce(name if name is not None else F.col("meeting_id"), F.lit("")), "")
        rows = minutes.withColumn("__json", F.to_json(F.struct("*"))).withColumn("__base", F.coalesce(F.nullif(base, F.lit("")), F.date_format(now, "yyyyMMdd-HHmmss")))
        numbered = F.regexp_extract("id", r"^(.*)-([0-9]{1,9})$", 2)
        ids = self._rows().select("id").distinct()
        used = ids.select(F.col("id").alias("__base"), F.lit(0).alias("k")).unionByName(ids.where(numbered != "").select(F.regexp_extract("id", r"^(.*)-([0-9]{1,9})$", 1).alias("__base"), numbered.cast("int").alias("k")))
        used = used.groupBy("__base").agg(F.max("k").alias("__last"), F.min("k").alias("__first"))
        rows = rows.join(used, "__base", "left")
        nth = F.row_number().over(W.partitionBy("__base").orderBy("meeting_id")) - 1
        last = F.coalesce("__last", F.lit(0))
        k = F.when(F.col("__first") == 0, last + 1 + nth).when(nth > 0, last + nth).otherwise(0)
        rows = rows.withColumn("id", F.when(k == 0, F.col("__base")).otherwise(F.concat_ws("-", "__base", k.cast("string"))))
        self._append(
            rows.select(
                "id", now.alias("at"), F.lit(False).alias("removed"), "title", "meeting_date", "duration_ms", F.size("speaker_labels").alias("n_speakers"), F.size("action_items").alias("n_actions"),
                F.coalesce("low_confidence", F.lit(0)).alias("low_confidence"), F.slice(F.transform("keywords", lambda x: x["word"]), 1, KEYWORDS).alias("keywords"), F.col("__json").alias("snapshot"),
            )
        )

    def list(self) -> DataFrame:
        """Summaries of all sessions, newest first. Snapshots aren't read."""
        return self._current().drop("snapshot").orderBy(F.col("at").desc(), F.col("id").desc())

    def load(self, name: str) -> DataFrame:
        """id, snapshot (JSON) of a session; no row if there is none."""
        return self._current().where(F.col("id") == tx.safe_name(F.lit(name), "")).select("id", "snapshot")

    def _remove(self, rows: DataFrame) -> None:
        gone = rows.withColumn("at", F.greatest(F.current_timestamp(), F.col("at"))).withColumn("removed", F.lit(True)).withColumn("snapshot", F.lit(None))
        self._append(gone)

    def remove(self, name: str) -> None:
        """Removes a session; an unknown name changes nothing."""
        self._remove(self._current().where(F.col("id") == tx.safe_name(F.lit(name), "")))

    def clear(self) -> None:
        self._remove(self._current())
