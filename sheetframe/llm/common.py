"""Helpers shared by the operators: bounded settings, shared-folder tables, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below spark.checkpoint.dir, which driver and executors share. It goes, with all that the
    operators wrote, when the driver ends, or by clean_up(). Where the setting is unset and the master is local, as in tests, a
    temporary folder stands in; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.applicationId in _made:
        return _made[sc.applicationId]
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a folder that driver and executors share is needed")
        base = "file://" + tempfile.mkdtemp(prefix="sheetframe-shared-")
    folder = f"{base.rstrip('/')}/sheetframe-{sc.applicationId}"
    path, store = _hadoop(spark, folder)
    store.mkdirs(path)
    store.deleteOnExit(path)
    _made[sc.applicationId] = folder
    return folder


def _hadoop(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def clean_up(spark: SparkSession) -> None:
    """Deletes all that the operators of this application wrote. Results that haven't been read or written elsewhere go too."""
    folder = _made.pop(spark.sparkContext.applicationId, None)
    if folder:
        path, store = _hadoop(spark, folder)
        store.delete(path, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, or one made from it, that no column of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def saved(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors, and makes
    whatever the plan sampled (range splitters, partition numbers) final before it is used twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes tables made by saved() that no later plan reads."""
    for df in frames:
        if found := getattr(df, "_saved_at", None):
            path, store = _hadoop(df.sparkSession, found)
            store.delete(path, True)


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id is in the one column of gone, null being an id like any other."""
    name = fresh("gone", docs)
    ids = gone.toDF(name)
    return docs.join(ids, docs[id_col].cast("long").eqNullSafe(ids[name]), "left_anti")


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more; else they stay until the
    driver's heap happens to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame, column: str) -> Column:
    """The column as text, null as the empty text."""
    return F.coalesce(df[column], F.lit(""))


#: Bytes of an Arrow batch that Python takes at a time: Spark sends 10,000 rows, of texts tens of MB and more as Python objects.
PIECE = 1 << 20


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in batches of about PIECE bytes; a row is never cut."""
    for batch in batches:
        rows = max(1, batch.num_rows * PIECE // max(batch.nbytes, PIECE))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Returns free memory to the system, where the C library can. A Python worker lives on after its task, and what its
    allocators keep is the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def by_pieces(fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, a function for mapInArrow, over its batches by pieces; what it has freed is given back at the end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(pieces(batches))
        finally:
            give_back()

    return run


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over each Arrow batch, by pieces."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(by_pieces(run), schema)
