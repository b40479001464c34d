"""What the operators of this subpackage share: the shared folder, durable tables and Arrow helpers.

Nothing here writes to a folder of one machine on a cluster: the folder is ``spark.checkpoint.dir``.  Only where
that is unset and the master is local (tests, notebooks) a temporary folder is made and set.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the tables that materialise() has written and that are still in use.
_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI below the session's shared folder; each call gives another one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="clausewright-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage with files that outlive any executor (unlike a local checkpoint), and fixes the
    outcome of steps with side effects: what a second action reads is what the first one wrote.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote, once all that reads it has itself been written."""
    for table in tables:
        if path := _stored.pop(table, None):
            jvm_path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(jvm_path, True)


def small_batches(spark: SparkSession, limit: str = "8m") -> None:
    """Bound the bytes of one Arrow batch, unless the session has its own bound: texts can be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1b") == f"{64 << 20}b":  # Spark's default
        spark.conf.set(key, limit)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it: local, HDFS, S3, GCS."""
    return pafs.FileSystem.from_uri(uri)


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut consecutive items into runs of at most ``most`` units, or one item if that is larger."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if len(sizes):
        out.append((begin, len(sizes)))
    return out


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21):
    """Parts of a batch with about ``most`` bytes of text, so that the work on one part stays small."""
    col = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0))
    for a, b in slices(sizes, most):
        yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply, xor-shift), used wherever a hash of integers is needed."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_key(text: Column) -> Column:
    """Identity of a whole text: its SHA-256; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def least_per_key(df: DataFrame, key: str, value: str, out: str, count: str = "copies") -> DataFrame:
    """For rows (key, value, salt) each key's least value and row count, safe for hot keys.

    Rows of a key are dealt over salts (see salt_of).  The least value and count are found part by part and
    then over the parts; only parts that exist get a row to join with, so a key that holds a third of all rows
    meets its rows in as many tasks as there are salts.  Returns (key, salt, out, count), to join on (key, salt).
    """
    part = df.groupBy(key, "salt").agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("c"))
    whole = part.groupBy(key).agg(F.min("m").alias(out), F.sum("c").alias(count), F.collect_list("salt").alias("salt"))
    return whole.select(key, out, count, F.explode("salt").alias("salt"))


def salt_of(*columns: str, salts: int = 64) -> Column:
    """Which of ``salts`` parts a row goes to, by a hash of other columns than the key."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int").alias("salt")


STEP, PIECE = 256, 4096


def with_bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas inside look at it again and again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, start: Column, move: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """What ``emit`` makes of each item and the state before it, nulls left out; ``move`` gives the state after it.

    Appending to an array copies it, so items are taken in steps of a few hundred: the cost grows with their number.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        return F.struct(move(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x))).alias("out"))

    def many(acc: Column, block: Column) -> Column:
        now = F.aggregate(block, F.struct(acc["now"]["at"].alias("at"), none.alias("out")), one)
        return F.struct(now.alias("now"), F.concat(acc["done"], F.array(acc["now"]["out"])).alias("done"))

    first = F.struct(F.struct(start.alias("at"), none.alias("out")).alias("now"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    begins = lambda xs: F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(STEP))
    blocks = with_bound(items, lambda xs: F.transform(begins(xs), lambda i: F.slice(xs, i + 1, F.lit(STEP))))
    made = F.aggregate(blocks, first, many, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]["out"]))))
    return F.filter(made, lambda x: x.isNotNull())


def pieces_of(text: Column) -> Column:
    """A text in pieces of equal numbers of code points, so that a place far into it is found without a walk."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a <= i < b of a text in pieces."""
    div = lambda x: F.floor(x / PIECE).cast("int")
    low = lambda k: F.greatest(a - k * PIECE, F.lit(0))
    some = F.transform(F.sequence(div(a), div(F.greatest(b - 1, a))), lambda k: F.substring(F.get(pieces, k), low(k) + 1, b - k * PIECE - low(k)))
    return F.when(a < b, F.array_join(some, "")).otherwise(F.lit(""))
