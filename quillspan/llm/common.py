"""Shared plumbing of the corpus operators: session set-up, durable cuts, Arrow maps."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Most bytes of one Arrow batch to a Python worker, which holds it several times over.
BATCH_BYTES = 2 << 20


def _bytes(setting: str) -> int:
    """Bytes of a size setting such as 64m, 8388608b or -1."""
    number, unit = setting.rstrip("bB"), 1
    if number and number[-1].lower() in "kmg":
        number, unit = number[:-1], 1 << {"k": 10, "m": 20, "g": 30}[number[-1].lower()]
    value = int(number) * unit
    return value if value > 0 else 1 << 62


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, bound their batches, and make sure a checkpoint folder is set.

    Batches of long texts are bounded by bytes (``BATCH_BYTES``), not only by rows.

    ``spark.checkpoint.dir`` is honoured where it is set. Where it is unset, a local master gets a
    temporary folder; any other master is refused, because its executors share no local folder. The
    bound on batches stays set: results are planned when the caller reads them, not here.
    """
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (_ROOT, path)))
    if _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or "cluster" in sc.master:
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="quillspan-ckpt-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Columns of one input table, through Spark's own reader."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


#: Checkpoint files of the operators that are running in this thread, innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder; partitions and their order are then fixed."""
    prepare(df.sparkSession)
    cut = df.checkpoint(eager=True)
    if scopes := _SCOPES.get():
        scopes[-1].append(_file_of(cut))
    return cut


def _file_of(cut: DataFrame) -> str:
    """The checkpoint file of a DataFrame that ``durable`` made."""
    return cut._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()


def release(*cuts: DataFrame | None) -> None:
    """Delete checkpoints that nothing reads any more."""
    for cut in cuts:
        if cut is not None:
            path = _file_of(cut)
            for scope in _SCOPES.get():
                if path in scope:
                    scope.remove(path)
            remove_folder(cut.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession, collect: bool = True) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Scope of an operator: what it checkpoints inside is deleted at its end, but for what it passes to ``keep``.

    A result that leaves the scope must read nothing but inputs and kept checkpoints. Shuffle files go when
    the driver's JVM finds their plans unreachable; ``collect`` asks it to look at the end of the scope,
    instead of at the half-hourly turn of Spark's cleaner.
    """
    files: list[str] = []
    kept: list[str] = []
    outer = _SCOPES.get()
    entered = _SCOPES.set((*outer, files))

    def keep(df: DataFrame) -> DataFrame:
        cut = durable(df)
        kept.append(_file_of(cut))
        return cut

    try:
        yield keep
    finally:
        _SCOPES.reset(entered)
        for path in files:
            if path not in kept:
                remove_folder(spark, path)
        if outer:
            outer[-1].extend(kept)
        if collect:
            collect_garbage(spark)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles of plans that are no longer held.

    Python tells the JVM of dropped plans from a thread that looks once a second, so the JVM is asked after that.
    """
    gc.collect()
    time.sleep(1.2)
    spark._jvm.System.gc()


#: Raw bytes up to which a measured table is broadcast.
BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, and hinted for broadcast if its measured size is within ``BROADCAST_BYTES``.

    Beyond the bound the join shuffles both sides; the result is the same.
    """
    return hinted(durable(df))


def measured(cut: DataFrame) -> int:
    """Bytes of a checkpointed table: of its files, which hold each row with an overhead, or counted where files are compressed."""
    spark = cut.sparkSession
    if spark.conf.get("spark.checkpoint.compress", "false") != "true":
        place = spark._jvm.org.apache.hadoop.fs.Path(_file_of(cut))
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    wide = [F.octet_length(f.name) for f in cut.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    wide += [16 * F.size(f.name) for f in cut.schema if isinstance(f.dataType, T.ArrayType)]
    width = 16 + 8 * len(cut.columns)
    return cut.agg(F.coalesce(F.sum(sum((F.coalesce(s, F.lit(0)) for s in wide), F.lit(width)).cast("long")), F.lit(0)).alias("b")).first()["b"]


def hinted(cut: DataFrame) -> DataFrame:
    """``small_side`` for a table that is checkpointed already."""
    total = measured(cut)
    return F.broadcast(fitted(cut, total)) if total <= BROADCAST_BYTES else cut


def fitted(cut: DataFrame, total: int | None = None) -> DataFrame:
    """A checkpointed table in no more partitions than its bytes need, one per ``BROADCAST_BYTES``.

    Tables of pairs and links have as many partitions as the shuffle that made them; where these are nearly
    empty they are read together, and a table that fits one partition needs no shuffle in further steps.
    """
    parts = -(-max(measured(cut) if total is None else total, 1) // BROADCAST_BYTES)
    return cut.coalesce(parts) if parts < cut._jdf.queryExecution().analyzed().rdd().getNumPartitions() else cut


def map_batches(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, Sequence]], schema: T.StructType | str, rows: int = 512
) -> DataFrame:
    """Apply ``fn`` (columns as Python lists in, columns out) to slices of Arrow batches.

    Slices of ``rows`` rows bound what a worker holds as Python objects, whatever the batch size.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
                del out
        give_back()

    return df.mapInArrow(run, schema)


def to_arrow(schema: T.StructType) -> pa.Schema:
    """Arrow schema of a flat Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer read, through Hadoop's file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers live long and serve many operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def global_rank(
    df: DataFrame, order: Sequence[str], extra: Sequence[T.StructField] = (T.StructField("rank", T.LongType()),), of_rank: Callable[[np.ndarray], list[np.ndarray]] = lambda rank: [rank]
) -> tuple[DataFrame, int]:
    """(rows with ``rank`` (long, from 0) in the given total order, number of rows).

    Range-partitioned and sorted, then checkpointed: partition sizes - all that reaches the driver -
    and row positions agree even if an executor is lost in between. Hot keys spread as far as the
    order tells their rows apart. ``extra`` and ``of_rank`` put columns made of the rank in its place,
    in the same pass.
    """
    n = shuffle_partitions(df.sparkSession)
    laid = durable(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["n"] for r in laid.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p] = total
        total += counts[p]
    kept = [f for f in laid.schema.fields if f.name != "_part"]
    schema = T.StructType([*kept, *extra])
    arrow = to_arrow(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            if batch.num_rows:
                part = batch.column(batch.schema.get_field_index("_part"))[0].as_py()
                rank = starts[part] + seen.get(part, 0) + np.arange(batch.num_rows)
                seen[part] = seen.get(part, 0) + batch.num_rows
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                made = [pa.array(v, arrow.field(f.name).type) for f, v in zip(extra, of_rank(rank))]
                yield pa.RecordBatch.from_arrays([*columns, *made], schema=arrow)
        give_back()

    return laid.mapInArrow(number, schema), total
