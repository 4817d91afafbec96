"""What the operators here share: Arrow batches in bounded slices, staged tables, names of columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable

#: Bytes of text that a slice holds at most, unless one text alone is longer.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 2048


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Only where none is set, on one machine as in tests, a temporary one is made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store holds it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession, folder: str) -> Iterator[None]:
    """What is staged inside goes to this folder, which is removed at the end: results must be written by then."""
    _SCRATCH.append(folder)
    try:
        yield
    finally:
        _SCRATCH.pop()
        remove(spark, folder)


def staged(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written to the shared folder and read again, so that no lost executor takes them along; and their path."""
    spark = df.sparkSession
    path = f"{_SCRATCH[-1] if _SCRATCH else shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def checkpointed(df: DataFrame) -> DataFrame:
    """staged() without the path: for rows that a lazy result reads."""
    return staged(df)[0]


def quoted(name: str) -> str:
    """A column's name as F.col() takes it, whatever stands in it."""
    return "`" + name.replace("`", "``") + "`"


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores added until no column has them, in any case of letters."""
    used, out = {n.lower() for n in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold at most `limit` bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, before + limit, side="right"))), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def map_rows(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> DataFrame:
    """One narrow pass over whole rows that keeps the columns, whatever their names: `run` sees them by place."""
    importable(df.sparkSession)
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list, list], list]],
    schema: str,
    names: list[str],
    types: list[pa.DataType],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One narrow pass over (id, text). `make()` runs once a task and returns f(ids, texts) -> columns."""
    importable(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, "text"):
                columns = work(part.column("id").to_pylist(), part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text")).mapInArrow(run, schema)
