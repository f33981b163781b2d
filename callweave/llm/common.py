"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a filter at the most (32 MB), and of one of its rows (a fixed value of the bitmap functions).
MOST_BITS, ROW_BITS = 1 << 28, 1 << 15
#: Bytes of a batch of texts on its way to Python and back.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares. Where the session names none, a local one serves a local master; a cluster is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex}")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session sending ``BATCH_BYTES`` to Python at once, or what it sends if that is less.

    Buffers double as they fill and are held on both sides, so that batches of 64 MB, Spark's own limit, take several times
    as much in each task.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(name)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


#: The operator whose task a worker ran last, and what lets go of all that it kept.
_last: tuple[str, Callable[[], None]] = ("", lambda: None)


@contextlib.contextmanager
def at_work(owner: str, let_go: Callable[[], None] = lambda: None) -> Iterator[None]:
    """Around a task of ``owner`` in a worker, which keeps the caches of one operator: those of another go first.

    Workers live through all stages of a session, and would else hold what every operator came to keep. At the end the memory
    that was freed goes back to the system, as allocators hold it for themselves.
    """
    global _last
    if _last[0] != owner:
        _last[1]()
        gc.collect()
    _last = owner, let_go
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # of other C libraries than glibc
            ctypes.CDLL(None).malloc_trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from there; ``drop`` deletes it."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables of ``cut`` of which nothing is read any more."""
    for t in tables:
        path = None if t is None else t.__dict__.get("cut_path")
        if path:
            context = t.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that do not clash with a column of ``df``, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def refuse(df: DataFrame, *names: str) -> None:
    taken = {c.lower() for c in df.columns}
    for name in names:
        if name.lower() in taken:
            raise ValueError(f"{name} is a column already")


def _place(col: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(col.cast("long"), F.lit(bits)), F.lit(bits))


def perhaps_in(df: DataFrame, col: str, ids: DataFrame, expected: int, out_col: str = "_in") -> DataFrame:
    """``df`` with ``out_col``: false only where ``col`` is in no row of ``ids`` (one long column); a true may be wrong.

    A bitmap of one hash takes 16 bits for each expected id, 32 MB at the most, so it can be sent to all executors. With more
    ids than it holds well it lets more through, and the exact join that follows does the rest.
    """
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (16 * max(1, expected) - 1).bit_length()))
    row, maps, at = fresh(df, "_row", "_map", "_at")
    place = _place(F.col(ids.columns[0]), bits)
    rows = ids.select(F.bitmap_bucket_number(place).alias(row), F.bitmap_bit_position(place).alias("bit"))
    rows = rows.groupBy(row).agg(F.bitmap_construct_agg("bit").alias(maps))
    here = _place(F.col(col), bits)
    both = df.withColumn(at, F.bitmap_bit_position(here)).withColumn(row, F.bitmap_bucket_number(here)).join(F.broadcast(rows), row, "left")
    byte = F.conv(F.hex(F.substring(F.col(maps), (F.col(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1, F.lit(False))
    return both.withColumn(out_col, hit).select(*df.columns, out_col)


def only(df: DataFrame, col: str, ids: DataFrame, expected: int) -> DataFrame:
    """Rows of ``df`` whose ``col`` is in ``ids`` (one column, distinct or not), shuffling hardly more than those."""
    (mark,) = fresh(df, "_in")
    few = perhaps_in(df, col, ids, expected, mark).where(F.col(mark)).drop(mark)
    return few.join(ids.select(F.col(ids.columns[0]).alias(col)).distinct(), col, "left_semi")
