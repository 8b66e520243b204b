"""Shared storage and membership filters for the training-data operators.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``; it is
read from the session. Only a local master without that setting gets a folder of this process, as
in tests; elsewhere its absence is an error. A written table survives the loss of any executor
and cuts the lineage of iterative jobs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A membership filter has 32 to 64 bits a key, within these bounds (as powers of 2). 2**28 bits are
#: 32 MB, the bound of what is broadcast; with over 2**27 keys it clears few rows, which costs a
#: shuffle of those rows and changes no result.
FILTER_LOG2, FILTER_LOG2_MOST = 16, 28
TEXT_ROWS, TEXT_BYTES = 400, 4 << 20
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="shared-"))
    return _local[0]


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in batches of at most TEXT_ROWS rows and about TEXT_BYTES bytes,
    unless the session says otherwise. The setting stays: lazy results need it when they run.

    The defaults of 10,000 rows and 64 MB are held at once by the JVM (off its heap) and by each
    worker. A row beyond TEXT_BYTES is a batch of its own.
    """
    for name, default, ours in ((_ROWS, "10000", TEXT_ROWS), (_BYTES, "67108864b", TEXT_BYTES)):
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, str(ours))


@contextmanager
def _batch_rows(spark: SparkSession, rows: int | None):
    """Batches of ``rows`` rows for what runs inside."""
    before = spark.conf.get(_ROWS, "10000")
    if rows:
        spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        if rows:
            spark.conf.set(_ROWS, before)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/larkspur/{label}-{uuid.uuid4().hex}"


def fresh_name(columns: Iterable[str], base: str) -> str:
    """``base``, or ``base`` with a number: a name that none of ``columns`` has, in any case."""
    taken, name, n = {c.lower() for c in columns}, base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}{n}"
    return name


def written(df: DataFrame, label: str, rows: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    Spark's commit protocol publishes only the files of successful task attempts. ``rows``: rows of
    the batches that Python workers get while this runs.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with _batch_rows(spark, rows):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that :func:`written` made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        root = f"{shared_dir(spark)}/larkspur/".split("://")[-1].split(":")[-1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if root in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class BitFilter:
    """A set of keys as bits, one hash of each: false positives only. Its rows are (block, bits)."""

    blocks: DataFrame
    log2: int

    @classmethod
    def of(cls, keys: DataFrame, key: str, label: str) -> BitFilter:
        """Of the values of a column; as many bits as the keys need, within the module's bounds. Built
        with map-side combination."""
        log2 = min(FILTER_LOG2_MOST, max(FILTER_LOG2, (32 * keys.count()).bit_length()))
        slot = F.pmod(F.xxhash64(key), F.lit(1 << log2))
        blocks = (
            keys.select(slot.alias("slot"))
            .groupBy(F.expr("bitmap_bucket_number(slot)").alias("block"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
        )
        return cls(written(blocks, label), log2)

    def flagged(self, df: DataFrame, key: Column) -> tuple[DataFrame, str, str]:
        """(``df`` with two columns more, the name of the key's column, that of the flag: may be in the set).
        The broadcast side is the filter, of bounded size by construction."""
        k, slot, block, pos, b, bits, flag = (fresh_name(df.columns, f"__{n}") for n in ("key", "slot", "block", "pos", "b", "bits", "maybe"))
        probe = df.withColumn(k, key).withColumn(slot, F.pmod(F.xxhash64(k), F.lit(1 << self.log2)))
        probe = probe.withColumn(block, F.expr(f"bitmap_bucket_number({slot})")).withColumn(pos, F.expr(f"bitmap_bit_position({slot})"))
        packed = self.blocks.select(F.col("block").alias(b), F.col("bits").alias(bits))
        hit = probe.join(F.broadcast(packed), F.col(block) == F.col(b), "left")
        byte = F.expr(f"cast(conv(hex(substring({bits}, cast({pos} div 8 as int) + 1, 1)), 16, 10) as bigint)")
        bit = byte.bitwiseAND(F.expr(f"shiftleft(1L, cast({pos} % 8 as int))")) != 0
        return hit.select(*[F.col(f"`{n}`") for n in df.columns], k, F.coalesce(bit, F.lit(False)).alias(flag)), k, flag

    def maybe(self, df: DataFrame, key: Column) -> DataFrame:
        """Rows of ``df`` whose key may be in the set (all true members, few others)."""
        found, k, flag = self.flagged(df, key)
        return found.where(flag).drop(k, flag)


def without_keys(df: DataFrame, key: Column, keys: DataFrame, label: str) -> DataFrame:
    """``df`` without the rows whose ``key`` is in the one column of ``keys``.

    Only rows that the filter cannot clear are shuffled for the exact anti-join, so wide rows
    that stay are not moved. Null keys are never dropped. Columns of ``df`` may have any names.
    """
    name = fresh_name(df.columns, "__gone")
    gone = written(keys.toDF(name).where(F.col(name).isNotNull()).distinct(), label)
    flagged, k, flag = BitFilter.of(gone, name, f"{label}-filter").flagged(df, key)
    names = [F.col(f"`{n}`") for n in df.columns]
    clear = flagged.where(~F.col(flag)).select(*names)
    unsure = flagged.where(flag).join(gone, F.col(k) == F.col(name), "left_anti").select(*names)
    return clear.unionByName(unsure)
