"""Session helpers: reading tables, and scratch tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a plain local session, as in tests, may go without the setting; it then gets a folder of its own. On a
    cluster a missing setting is an error, as a folder of one machine would be lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-covermill-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


class Scratch:
    """Tables written to the shared folder; each cuts the lineage and outlives lost executors.

    ``keep`` writes a table and reads it back; ``drop`` deletes one that no later plan reads. What is left is
    deleted when the session's file system closes.

    With a ``name``, a signature of all that the work depends on, the tables outlive the session: a run that was ended
    goes on with the first table that was not written whole, as the same work keeps the same tables in the same order.
    Nothing is dropped then before ``remove``, and rounds of covers and sweeps need not be done again.
    """

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark, self.named = spark, name is not None
        self.root = f"{shared_dir(spark)}/covermill-{name or uuid.uuid4().hex}"
        self.count = 0
        if not self.named:
            self._fs().deleteOnExit(self._path(self.root))

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def keep(self, df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """With ``by``, rows lie in folders by these columns, so that a filter on them reads its folders only."""
        self.count += 1
        name = f"{self.root}/{self.count}"
        if not self.named or not self._fs().exists(self._path(f"{name}/_SUCCESS")):
            (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(name)
        kept = self.spark.read.schema(df.schema).parquet(name)
        kept._scratch_name = name
        return kept

    def keep_by(self, df: DataFrame, key: str) -> DataFrame:
        """A table in buckets by the hash of ``key``, as many as the session shuffles to: joins on the key do not
        shuffle it again."""
        self.count += 1
        name, n = f"{self.root}/{self.count}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"covermill_{uuid.uuid4().hex}"
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).mode("overwrite").option("path", name).saveAsTable(table)
        kept = self.spark.table(table)
        kept._scratch_name = name
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for df in [] if self.named else tables:
            self._fs().delete(self._path(df._scratch_name), True)

    def remove(self) -> None:
        self._fs().delete(self._path(self.root), True)


#: Rows of a table that may be broadcast: of a few numbers each, some tens of MB.
MOST_BROADCAST = 1 << 20


def small_side(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The side of a join, to be broadcast if it has at most ``most`` rows; else Spark shuffles it. Rows of a written
    table are counted from its footers."""
    return F.broadcast(df) if df.count() <= most else df


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
