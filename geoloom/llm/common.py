"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoloom.sources.tables import shared_folder as shared_dir

#: The ASCII white space that separates words everywhere in this subpackage.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"

#: Bytes of text that a Python task looks at together.
GROUP_BYTES = 4 << 20


_shipped: set[tuple[str, str]] = set()
_written: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once in an application; the archive goes when the driver ends."""
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if (app, "") in _shipped or root.suffix == ".zip":
        return
    folder = tempfile.mkdtemp(prefix="geoloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/geoloom", "zip", root, "geoloom"))
    _shipped.add((app, ""))


@dataclass(frozen=True)
class ShippedFile:
    """A file that every executor has a copy of."""

    name: str

    def path(self) -> str:
        return SparkFiles.get(self.name)


def ship_file(spark: SparkSession, path: str) -> ShippedFile:
    """Send one file of the driver's machine, such as a vocabulary, to the executors, once in an application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _shipped:
        spark.sparkContext.addFile(path)
        _shipped.add(key)
    return ShippedFile(Path(path).name)


def map_arrow(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow, with this package at hand in the tasks."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there, and a lost executor costs no rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    written(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


#: Hashes are taken modulo this where rows are picked by them: fine enough for any number of rows.
HASH_RANGE = 1 << 40


def picked_by_hash(salt: str, *columns: str, share: Column | float) -> Column:
    """Whether a row is among about share of all rows, by a hash of its columns."""
    place = F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(HASH_RANGE))
    return place < F.ceil((share if isinstance(share, Column) else F.lit(float(share))) * HASH_RANGE)


def written(path: str | None = None) -> int:
    """Note a path for remove_tables(); the number of paths noted before."""
    if path:
        _written.append(path)
    return len(_written) - bool(path)


def remove_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete what materialize() and the token store wrote in this application, from the since-th path on but for the last
    keep ones. To be called when the results that rest on it are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _written[since : len(_written) - keep]
    del _written[since : len(_written) - keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def map_rows(
    df: DataFrame,
    start: Callable[[], Callable[[list[str]], dict[str, list]]],
    columns: list[str],
    text_col: str,
    fields: str,
) -> DataFrame:
    """Keep columns and add fields, made in Python from groups of whole texts. No rows in, no rows out.

    start() runs once in each task and returns a function of texts that returns the new columns. Null texts reach it as "". Groups hold GROUP_BYTES of text or one longer text, so memory follows the longest text.
    """
    picked = df.select(*columns, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    added = df.sparkSession.createDataFrame([], fields).schema
    schema = picked.drop("__text").schema
    for f in added:
        schema = schema.add(f)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or start()
            for at, n in groups(batch.column("__text")):
                part = batch.slice(at, n)
                out = step(part.column("__text").to_pylist())
                arrays = [part.column(i) for i in range(len(columns))]
                arrays += [pa.array(out[f.name], type=ARROW[f.dataType.simpleString()]) for f in added]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *added.names])

    return map_arrow(picked, run, schema)


ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}


def groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of rows with about GROUP_BYTES of text each."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + GROUP_BYTES, side="right")))
        yield at, to - at
        at = to


def filter_rows(df: DataFrame, start: Callable[[], Callable[[list[str]], list[bool]]], text_col: str) -> DataFrame:
    """The rows of df, with all their columns, whose whole text passes; start() as in map_rows, its function says which pass.
    Null texts reach it as ""; rows that repeat pass or go together; no rows in, no rows out."""
    at_text = df.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or start()
            for at, n in groups(batch.column(at_text)):
                part = batch.slice(at, n)
                keeps = step([t or "" for t in part.column(at_text).to_pylist()])
                yield part.filter(pa.array([bool(k) for k in keeps], pa.bool_()))

    return map_arrow(df, run, df.schema)
