"""Intermediate tables in the shared folder, joins by measured size, sums in order without one task."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, NumericType, StringType, StructType

#: Measured bytes up to which the narrow side of a join is broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 4 << 20

_own_dirs: dict[str, str] = {}
_used: set[tuple[str, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset a local master gets one of its
    own; on a cluster it is an error, as executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="folioquery-")
        base = _own_dirs[app]
    return base.rstrip("/")


def store_of(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever store it lies."""
    store, at = store_of(spark, path)
    store.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    store, at = store_of(spark, path)
    return store.exists(at)


def _clear(spark: SparkSession, folder: str) -> None:
    """Remove an application's folder at the end of its driver; one that stopped Spark before leaves
    it to whoever clears the shared folder."""
    if spark.sparkContext._jsc is not None:
        remove(spark, folder)


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own below the application's folder, which goes when the driver ends."""
    folder = f"{shared_dir(spark)}/folioquery/{spark.sparkContext.applicationId}"
    if (spark.sparkContext.applicationId, folder) not in _used:
        _used.add((spark.sparkContext.applicationId, folder))
        atexit.register(_clear, spark, folder)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, at: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{at}/{tag}-{uuid.uuid4().hex}" if at else new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables that one computation needs on its way; all go when the block ends, so what is returned
    has to be materialised outside of it.

        with Workspace(spark, "mix") as work:
            sums = work.table(sums, "sums")
            return materialize(result, "mix")
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path = spark, new_path(spark, tag)

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *raised) -> None:
        remove(self.spark, self.path)

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        return materialize(df, tag, self.path)


def _fixed_width(kind) -> int:
    return sum(_fixed_width(f.dataType) for f in kind) if isinstance(kind, StructType) else 16 if isinstance(kind, (StringType, BinaryType)) else 8


def measured_bytes(df: DataFrame) -> int:
    """About the bytes that the rows of df take in memory: counted rows and measured strings."""
    kinds = {f.name: f.dataType for f in df.schema}
    if not all(isinstance(k, (StringType, BinaryType, StructType)) or isinstance(k, NumericType) or k.typeName() in ("boolean", "date", "timestamp") for k in kinds.values()):
        raise TypeError("only rows of plain values are measured")
    lengths = [F.sum(F.octet_length(f"`{n}`")) for n, k in kinds.items() if isinstance(k, (StringType, BinaryType))]
    found = df.agg(F.count("*"), *lengths).first()
    return found[0] * (16 + sum(map(_fixed_width, kinds.values()))) + sum(x or 0 for x in found[1:])


def join_checked(wide: DataFrame, narrow: DataFrame, on, how: str = "inner", limit: int | None = None) -> DataFrame:
    """Join that broadcasts narrow (which must be materialised) when its measured bytes are within
    limit; beyond that a shuffled join, whose skewed partitions adaptive execution splits."""
    if measured_bytes(narrow) <= (BROADCAST_BYTES if limit is None else limit):
        return wide.join(F.broadcast(narrow), on, how)
    return wide.join(narrow.hint("merge"), on, how)


def small_batches(spark: SparkSession) -> None:
    """Batches for Python workers of at most BATCH_BYTES, a longer row alone. The size is a setting of
    the session and read when a plan runs, so it is lowered there and stays."""
    conf, name = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in small_batches()."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """names, changed where df has columns that are called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def running_sums(rows: DataFrame, order: list, sums: dict[str, str], work: Workspace) -> DataFrame:
    """rows with, for each column named in sums, its sum over all rows before under the name given.
    order: columns or their sort expressions, which together tell rows apart.

    Ranges of the order are summed each on its own and moved up by the sums of the ranges before, so
    that only one row for each range meets in one task."""
    part, *moves = free_names(rows, "range_no", *(f"range_{name}" for name in sums.values()))
    ranged = work.table(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    whole = ranged.groupBy(part).agg(*[F.sum(c).alias(m) for c, m in zip(sums, moves)])
    earlier = W.orderBy(part)
    before = whole.select(part, *[(F.sum(m).over(earlier) - F.col(m)).alias(m) for m in moves])
    within = W.partitionBy(part).orderBy(*order)
    summed = ranged.withColumns({name: F.sum(c).over(within) - F.col(c) for c, name in sums.items()})
    moved = summed.join(F.broadcast(before), part)  # a row for each range
    return moved.withColumns({name: (F.col(name) + F.col(m)).cast("long") for name, m in zip(sums.values(), moves)}).drop(part, *moves)


def last_before(rows: DataFrame, key: str, order: list, column: str, name: str, most: int = 1 << 20) -> DataFrame:
    """rows with the last value of column that is not null among the rows before of the same key
    (null is a key too) under name; order: columns, which together tell a key's rows apart.

    Keys of up to most rows are windows. A longer one is cut into ranges of the order: each range finds
    its own last values, and one row for each range carries them on, as the last of what is there is
    the last of two neighbours, whichever come first."""
    by = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = F.last(column, ignorenulls=True)
    count, part, carried = free_names(rows, "key_rows", "range_no", "carried")
    sized = rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias(count)).filter(F.col(count) > most)
    long = materialize(sized.select("k"), "long-keys")
    if long.isEmpty():
        return rows.withColumn(name, within.over(by))
    is_long = rows[key].eqNullSafe(long["k"])
    short = rows.join(F.broadcast(long), is_long, "left_anti").withColumn(name, within.over(by))  # keys of over most rows are few
    cut = rows.join(F.broadcast(long), is_long, "left_semi").repartitionByRange(key, *order)
    ranged = materialize(cut.withColumn(part, F.spark_partition_id()), "ranges")
    struct = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    ends = ranged.groupBy(part, key).agg(F.max_by(column, F.when(F.col(column).isNotNull(), struct)).alias(carried))
    through = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    before = materialize(ends.select(part, key, F.last(carried, ignorenulls=True).over(through).alias(carried)), "carried")
    own = W.partitionBy(part, key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    found = ranged.withColumn(name, within.over(own)).alias("r")
    b = before.select(F.col(part).alias("bp"), F.col(key).alias("bk"), carried)
    joined = found.join(F.broadcast(b), (F.col(f"r.{part}") == F.col("bp")) & F.col(f"r.{key}").eqNullSafe(F.col("bk")))  # a row for each range and long key
    filled = F.coalesce(F.col(name), F.col(carried)).alias(name)
    return short.unionByName(joined.select(*[F.col(f"r.{c}") for c in rows.columns], filled))
