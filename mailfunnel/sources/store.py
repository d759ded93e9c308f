"""Cards, events and sync state as tables kept by user (S3-S5 as stored, J1 and F10 on them).

Each table is bucketed by ``user_id`` and partitioned by ``slot``, the bucket's number, so a batch rewrites only the slots of its
users, and a join on the user reads the stored side as it lies. A batch is first written aside whole, then its slots are
overwritten, then it is marked done: a run that dies in between is completed from what stands aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import APPLICATIONS, EVENTS, SYNC_STATE


def configured(spark: SparkSession) -> SparkSession:
    """Lets a join on (user, message) use tables that are bucketed by user alone."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


class Tables:
    """The stored tables under one path. ``slots`` is fixed when the tables are made."""

    def __init__(self, spark: SparkSession, path: str, apps_schema: str = APPLICATIONS, slots: int = 64):
        self.spark, self.path, self.slots = configured(spark), path, slots
        self.schemas = {"applications": apps_schema, "events": EVENTS, "sync_state": SYNC_STATE}
        mark = hashlib.sha256(path.encode()).hexdigest()[:16]
        self.names = {n: f"mail_{n}_{mark}" for n in self.schemas}
        for n, schema in self.schemas.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.names[n]} ({schema}, slot int) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY (slot) CLUSTERED BY (user_id) INTO {slots} BUCKETS LOCATION '{path}/{n}'")
            spark.catalog.refreshTable(self.names[n])

    def slot(self, user="user_id"):
        """The bucket that Spark deals the user to."""
        return F.pmod(F.hash(F.col(user).cast("long")), F.lit(self.slots))

    def slots_of(self, users: DataFrame) -> list[int]:
        """At most ``slots`` numbers."""
        return sorted(r.s for r in users.select(self.slot().alias("s")).distinct().collect())

    def _hadoop(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        found, fs = self._hadoop(path)
        return fs.exists(found)

    def _delete(self, path: str) -> None:
        found, fs = self._hadoop(path)
        fs.delete(found, True)

    def done(self) -> int:
        """The last batch that stands in the tables; -1 before the first."""
        if not self._exists(f"{self.path}/done"):
            return -1
        return self.spark.read.schema("batch long").parquet(f"{self.path}/done").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def table(self, name: str, slots: Iterable[int] | None = None) -> DataFrame:
        """A stored table, or those of its slots: the others' files are not read."""
        df = self.spark.table(self.names[name])
        return (df if slots is None else df.where(F.col("slot").isin(*slots))).drop("slot")

    def current(self, slots: Iterable[int] | None = None) -> dict[str, DataFrame]:
        return {n: self.table(n, slots) for n in self.schemas}

    def of_user(self, name: str, user_id: int) -> DataFrame:
        """one user's rows; of the table one bucket is read."""
        return self.spark.table(self.names[name]).where((F.col("slot") == self._slot_of(user_id)) & (F.col("user_id") == user_id)).drop("slot")

    def _slot_of(self, user_id: int) -> int:
        return self.spark.range(1).select(F.pmod(F.hash(F.lit(user_id).cast("long")), F.lit(self.slots))).first()[0]

    def commit(self, batch: int, tables: dict[str, DataFrame], slots: Iterable[int] | None = None) -> None:
        """``tables`` hold all rows of ``slots`` (None: of every slot) after the batch; other slots keep their files."""
        slots = sorted(range(self.slots) if slots is None else slots)
        aside = f"{self.path}/aside/{batch}"
        for n, df in tables.items():
            kept = df.select(*[c.split()[0] for c in self.schemas[n].split(", ")]).withColumn("slot", self.slot())
            kept.repartition(self.slots, "user_id").write.mode("overwrite").partitionBy("slot").parquet(f"{aside}/{n}")
        self.spark.createDataFrame([(batch, slots, sorted(tables))], "batch long, slots array<int>, tables array<string>").coalesce(1).write.mode("overwrite").parquet(f"{aside}/ready")
        self._apply(batch)

    def _apply(self, batch: int) -> None:
        aside = f"{self.path}/aside/{batch}"
        ready = self.spark.read.parquet(f"{aside}/ready").first()
        for n in ready.tables:
            columns = [c.split()[0] for c in self.schemas[n].split(", ")]
            new = self.spark.read.schema(f"{self.schemas[n]}, slot int").parquet(f"{aside}/{n}").select(*columns, "slot")
            new.repartition(self.slots, "user_id").write.insertInto(self.names[n], overwrite=True)
            filled = {r.slot for r in new.select("slot").distinct().collect()}
            for empty in set(ready.slots) - filled:  # an overwrite leaves a slot alone that it has no row for
                self._delete(f"{self.path}/{n}/slot={empty}")
            self.spark.catalog.refreshTable(self.names[n])
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.path}/done")
        self._delete(aside)

    def recover(self, batch: int) -> bool:
        """Completes the batch if it was written aside before; True if it stands in the tables."""
        if batch <= self.done():
            return True
        if self._exists(f"{self.path}/aside/{batch}/ready/_SUCCESS"):
            self._apply(batch)
            return True
        return False
