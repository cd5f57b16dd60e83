"""What the corpus operators share: tables, the checkpoint folder, Arrow streaming, bounded caches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch sent to Python; documents may be long, so it is kept small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent on a local master, as in tests, a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = f"file://{tempfile.mkdtemp(prefix='sparrowdex-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable checkpoint; Spark removes its files when nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that Spark removes the shuffle files of plans that nothing refers to any more.

    Otherwise they stay on the executors' disks until the driver happens to run short of memory.
    """
    spark.sparkContext._jvm.System.gc()


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def keep_written(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: compact, and safe when executors are lost."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; read by Spark when a plan runs, so it stays set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception:  # noqa: BLE001  older Spark has no such setting
        pass


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % n


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def utf8(texts: list) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in texts]


def together(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The first ``n`` columns' values and the other columns' rows of each run of rows that agree in these; runs go on over batches."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n] != now:
                if rows:
                    yield now, rows
                now, rows = row[:n], []
            rows.append(row[n:])
    if rows:
        yield now, rows


#: What a worker keeps from task to task, by the module whose work fills it.
_kept: dict[str, dict] = {}


def kept_by(module: str) -> dict:
    """A dictionary that a worker keeps until other modules' tidy work begins in it."""
    return _kept.setdefault(module, {})


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def make_room(module: str) -> None:
    """Drop what other modules' work has kept in this worker."""
    others = [held for name, held in _kept.items() if name != module and held]
    for held in others:
        held.clear()
    if others:
        give_back()


def tidy(work):
    """``work`` on Arrow batches, before which the worker drops what it keeps for other modules and after which freed memory goes
    back to the system: workers serve one stage after the other, and those that wait for their next task would hold it."""
    module = work.__module__

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(module)
        yield from work(batches)
        give_back()

    return tidied


class Memo(dict):
    """A dictionary that makes what it lacks; beyond ``most`` entries it becomes the older of two generations, whose entries in use move on."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
