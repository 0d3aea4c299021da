"""Where tables come from (files in a folder, or a database), and where interim ones go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one narrow column that may be sent to every executor.
BROADCAST_ROWS = 200_000


def small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows, marked for sending to every executor if they are counted to be most or fewer. More are left to a shuffle, before
    which Spark drops what can't match by a bloom filter where that pays."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out evenly to as many tasks as shuffles have, two a core at least: for rows of which each makes many."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one if it is unset and all run on this
    machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="geoloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table of the shared folder: what made them isn't asked again."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def from_folder(spark: SparkSession, folder: str, names: list[str], suffix: str = ".parquet") -> dict[str, DataFrame]:
    """Parquet tables of a folder, by name."""
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}{suffix}") for name in names}


def from_database(spark: SparkSession, url: str, tables: dict[str, str], options: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables of a database over JDBC, by name; tables maps names to relations.

    Filters and columns are pushed down by Spark. options: driver, user and the like; give partitionColumn, lowerBound,
    upperBound and numPartitions for a large table, or a single task reads it.
    """
    read = lambda relation: spark.read.format("jdbc").options(**(options or {})).option("url", url).option("dbtable", relation).load()
    return {name: read(relation) for name, relation in tables.items()}
