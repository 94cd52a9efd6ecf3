"""What the corpus operators share: word and line expressions, names that cannot clash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.plans.session import checkpoint_folder, settle, ship  # noqa: F401  (used by the operators)

#: ASCII white space, as a Java and DuckDB character class.
SPACE = r"[\x20\x09-\x0D]"
#: Prefix of working columns; a table's own columns do not start with it.
OWN = "__pl_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Maximal runs of other than ASCII white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside higher-order functions."""
    return F.transform(F.array(value), body).getItem(0)


#: Rows of at most this many 32-byte ids, about 10 MB, may be broadcast.
SMALL_ROWS = 300_000


def sized(ids: DataFrame) -> DataFrame:
    """A list of ids with a broadcast hint if its counted rows allow it; otherwise it joins by a shuffle."""
    return F.broadcast(ids) if ids.count() <= SMALL_ROWS else ids


class Scratch:
    """Tables written to the cluster's checkpoint folder: they cut lineage, survive lost executors, and go once they are superseded."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.made = 0
        self.live: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, written and read again."""
        path, self.made = f"{self.root}/{self.made}", self.made + 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.live.append((out, path))
        return out

    def only(self, *tables: DataFrame | None) -> None:
        """Delete all tables but these."""
        fs, stay = self.spark._jvm.org.apache.hadoop.fs, []
        for table, path in self.live:
            if any(table is x for x in tables):
                stay.append((table, path))
            else:
                where = fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.live = stay
