"""What several training-data operators share: the shared folder, written stages, guarded joins.

Words are everywhere the runs of characters other than space, tab, line feed, vertical tab,
form feed and carriage return (code points 0x20, 0x09 to 0x0D). On UTF-8 bytes these are
exactly the pieces of ``bytes.split()``.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The word pattern of all operators, for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table may be broadcast; beyond it the join is dealt out with salt.
BROADCAST_ROWS = 20_000
SALTS = 32

#: Bits of a key filter for each key, its most bits (32 MB), and bits in one of its rows.
KEY_BITS, MAX_FILTER_BITS, ROW_BITS = 16, 1 << 28, 1 << 15
_WORKER: dict = {}
_WRITTEN: list[str] = []


# written stages -----------------------------------------------------------------------------
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session in one process gets a folder of its own, and any other an error,
    since executors elsewhere could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it stays until discard() or release()."""
    path = f"{shared_dir(spark)}/termforge/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._termforge_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for df, once nothing reads it any more."""
    path = df._termforge_path
    _WRITTEN.remove(path)
    _delete(df.sparkSession, path)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what this process wrote into the shared folder (after the first `since` paths), but for keep.

    For callers that have consumed the results: DataFrames that operators returned read these files.
    """
    kept = getattr(keep, "_termforge_path", None)
    for path in [p for p in _WRITTEN[since:] if p != kept]:
        _WRITTEN.remove(path)
        _delete(spark, path)


def written() -> int:
    """How many paths stand in the shared folder, for release()."""
    return len(_WRITTEN)


# workers ------------------------------------------------------------------------------------
def resident(key, make: Callable):
    """What make() gives, kept in this Python worker until another key is asked for.

    Workers outlive stages; so one holds the tables of one operator at a time.
    """
    if key not in _WORKER:
        _WORKER.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library: it keeps the freed memory
            pass
        _WORKER[key] = make()
    return _WORKER[key]


# joins --------------------------------------------------------------------------------------
def same(a, b):
    """Equality that holds between nulls."""
    return a.eqNullSafe(b)


def join_per_key(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join rows with a table of one row per key (nulls match nulls), however uneven the keys are.

    A table of at most `limit` rows, counted first, is broadcast. A larger one is
    repeated SALTS times and the rows of each key are dealt over the salts, so that a key
    with a third of all rows is spread over SALTS tasks. The table should be materialised.
    """
    names = {k: f"__key_{i}" for i, k in enumerate(keys)}
    other = table.withColumnsRenamed(names)
    on = [same(rows[k], other[names[k]]) for k in keys]
    if table.limit(limit + 1).count() <= limit:
        out = rows.join(F.broadcast(other), reduce(lambda a, b: a & b, on), how)
    else:
        rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        other = other.withColumn("__salt_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = [same(rows[k], other[names[k]]) for k in keys] + [rows["__salt"] == other["__salt_t"]]
        out = rows.join(other, reduce(lambda a, b: a & b, on), how).drop("__salt", "__salt_t")
    return out.drop(*names.values())


# key filters --------------------------------------------------------------------------------
class KeyFilter:
    """A hashed bitmap of long keys: rows that surely have none of the keys are told without a shuffle.

    There are no misses; other rows pass at a rate of about 1 in KEY_BITS while the keys fit
    MAX_FILTER_BITS, and at a growing rate beyond, so an exact join must follow. The bitmap is
    a table of n_bits / ROW_BITS rows of 4 kB, 32 MB at most, whatever the number of keys.
    """

    def __init__(self, keys: DataFrame, name: str = "key-filter"):
        """keys: one column of longs."""
        n = max(1, keys.count())
        self.n_bits = min(MAX_FILTER_BITS, max(ROW_BITS, 1 << (KEY_BITS * n - 1).bit_length()))
        place = self._place(F.col(keys.columns[0]))
        bits = keys.groupBy(F.shiftright(place, 15).alias("__row")).agg(F.bitmap_construct_agg(place % ROW_BITS).alias("__bits"))
        self.table = materialize(bits, name)

    def _place(self, key: Column) -> Column:
        # hashed again, so that bits don't repeat a pattern of the keys
        return F.pmod(F.xxhash64(key), F.lit(self.n_bits).cast("long"))

    def mark(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """rows with a boolean column: whether the key may be among the keys."""
        place = self._place(key)
        marked = rows.withColumn("__place", place).withColumn("__at", F.shiftright("__place", 15))
        marked = marked.join(F.broadcast(self.table), F.col("__at") == F.col("__row"), "left")
        bit = (F.col("__place") % ROW_BITS).cast("int")
        byte = F.conv(F.hex(F.substring("__bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.getbit(byte, bit % 8) == 1
        return marked.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__place", "__at", "__row", "__bits")
