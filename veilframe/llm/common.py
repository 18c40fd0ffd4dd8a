"""What the operators of this subpackage share: table access, Arrow kernels, shared scratch tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are cut so that one kernel call sees at most this many bytes of text (one text always fits).
KERNEL_BYTES = 16 << 20
#: Spark's setting by which a query's shuffle files go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables of this session in the shared folder.
WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of a folder. With spread, one of fewer file splits than cores is dealt to all cores; rows stay the same."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df._jdf.rdd().getNumPartitions() < cores else df


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the session's cluster shares, from spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder. On a cluster such a folder is on one machine only,
    so it is refused there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veilframe-"))
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    return jvm_dir.get()


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables; called for each when the driver's Python ends, or before, once nothing reads it."""
    if spark.sparkContext._jsc is None:
        return  # the session has ended; the cluster's own clean-up remains
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside let go of their shuffle files when they end: their result is written, nothing reads them again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back.

    The written table survives lost executors; a later stage recomputes from it, not from the corpus. Tables are deleted
    when the driver's Python ends, or by dropping().
    """
    return written(df, name)[0]


@contextmanager
def dropping(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """As materialize; the table is deleted at the end of the with block, so nothing lazy may read it after that."""
    out, path = written(df, name)
    yield out
    WRITTEN.remove(path)
    drop_scratch(df.sparkSession, [path])


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if not WRITTEN:
        atexit.register(drop_scratch, spark, WRITTEN)
    WRITTEN.append(path)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text modulo modulus; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def cut(batch: pa.RecordBatch, text: str, limit: int = KERNEL_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most limit bytes of text, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    if column.nbytes <= limit:
        yield batch
        return
    sizes = [0 if v is None else v for v in pc.binary_length(column).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def map_text(df: DataFrame, factory: Callable, schema: str, keys: list[str], text: str = "text") -> DataFrame:
    """keys plus the columns that a text kernel makes, one row per row of df; no shuffle.

    factory() is called once per task and returns kernel(list of str) -> {column: values}. A null text is "".
    """
    kept = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    key_fields = [kept.schema[k] for k in keys]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    extra = _parse_datatype_string(schema)
    target = to_arrow_schema(StructType(extra.fields))

    def run(batches):
        kernel = factory()
        for whole in batches:
            for batch in cut(whole, "__text"):
                out = kernel(batch.column(len(keys)).to_pylist())
                arrays = [batch.column(i) for i in range(len(keys))] + [pa.array(out[f.name], type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *target.names])

    return kept.mapInArrow(run, StructType(key_fields + extra.fields))
