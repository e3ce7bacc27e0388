"""What the operators of this folder share: tables, placed intermediates, query registry."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import prepare, scratch_path

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that gives the same rows where there is one."""

    def add(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(prepare(spark), sf_dir)

        PLANS[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return plan

    return add


def settle(df: DataFrame, name: str = "settled", row_group: int | None = None) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    ``row_group``: bytes of a row group, for wide rows.  Without it the writer first
    looks at what it holds after a hundred rows, and readers take as many at once.

    Zstandard frees its buffers when a file is closed.  Snappy's are kept until
    the collector comes by, which adds up where many tasks write small files.
    """
    path = scratch_path(df.sparkSession, name)
    wide = {} if row_group is None else {"parquet.block.size": row_group} | dict.fromkeys(_SIZE_CHECKS, 1)
    with _short_plans(df.sparkSession):
        df.write.options(compression="zstd", **wide).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    for made in _RECORDS:
        made.append(out)
    return out


_SIZE_CHECKS = ("parquet.block.size.row.check.min", "parquet.page.size.row.check.min")


@contextlib.contextmanager
def _short_plans(spark: SparkSession) -> Iterator[None]:
    """The driver keeps a text of every plan it has run; those of intermediate tables are cut."""
    name = "spark.sql.maxPlanStringLength"
    was = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        yield
    finally:
        spark.conf.set(name, was)


_PATHS: dict[int, tuple[DataFrame, str]] = {}


def release(*settled: DataFrame) -> None:
    """Remove settled tables that nothing reads any more."""
    for df in settled:
        _, path = _PATHS.pop(id(df))
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes after which a batch of rows goes to a Python worker; only a single longer row makes a larger one.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches by bytes: by rows alone, one of long texts takes tens of megabytes on both sides of a task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sent(spark: SparkSession, value):
    """A broadcast value; its size is for the caller to bound."""
    out = spark.sparkContext.broadcast(value)
    for made in _RECORDS:
        made.append(out)
    return out


_RECORDS: list[list] = []


@contextlib.contextmanager
def recorded() -> Iterator[list]:
    """The settled tables and broadcasts made inside, for ``free`` once nothing reads them any more."""
    made: list = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.remove(made)


def take_back(one) -> None:
    """A broadcast that no later job needs."""
    for made in _RECORDS:
        made[:] = [x for x in made if x is not one]
    one.destroy()


def free(spark: SparkSession, made: list) -> None:
    """Give back tables and broadcasts, and what memory of the driver they held."""
    while made:
        one = made.pop()
        if not isinstance(one, DataFrame):
            one.destroy()
        elif id(one) in _PATHS:
            release(one)
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fresh(name: str) -> str:
    """A column name that no input table has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def sampled(df: DataFrame, by: Column, rate: Column) -> DataFrame:
    """Rows whose hash falls in the first ``rate`` of the hash range: the same on every run."""
    return df.filter(F.pmod(F.xxhash64(by, F.lit(11)), F.lit(1 << 30)) < rate * float(1 << 30))


#: Bits of the filter below; the broadcast table has this many / 64 rows at most, whatever the number of keys.
FILTER_BITS = 1 << 24


def _bit(column: Column) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(29)), F.lit(FILTER_BITS))


def likely_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose key may be among ``keys``: all that are, and a few others.

    A filter of fixed size goes to every task, so that a join that follows
    moves little more than the rows it keeps.  With very many keys it lets
    everything through and is merely of no use.
    """
    word, bits = fresh("word"), fresh("bits")
    at = _bit(F.col(column))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    table = keys.groupBy(F.floor(at / 64).alias(word)).agg(F.bit_or(one).alias(bits))
    hit = F.col(bits).bitwiseAND(one) != 0
    return df.withColumn(word, F.floor(at / 64)).join(F.broadcast(table), word).filter(hit).drop(word, bits)
