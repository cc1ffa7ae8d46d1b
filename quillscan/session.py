"""What every plan needs of the session: tables, scratch space and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured size is below this.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (a local session, as in tests) a folder of this process is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillscan-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by files in the shared folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: columns can be pruned later,
    and a lost executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillscan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables that this process has stored and not yet discarded.
_made: list[str] = []


def discard(spark: SparkSession, first: int = 0, more: tuple[str, ...] = ()) -> int:
    """Deletes the tables stored since ``stored_so_far`` was ``first``, and the paths ``more``: for a caller that has written
    whatever was made of them. Returns how many tables are left."""
    for path in [*_made[first:], *more]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del _made[first:]
    return len(_made)


def stored_so_far() -> int:
    return len(_made)


#: Bytes that any row takes in a broadcast table beside its values' own.
_ROW = 32


def small_enough(df: DataFrame, limit: int | None = None) -> bool:
    """Whether ``df`` takes at most ``limit`` bytes (by default BROADCAST_BYTES): its rows are counted and measured, up to the
    first row beyond that could lie within."""
    limit = BROADCAST_BYTES if limit is None else limit
    most = max(1, limit // _ROW)
    size = F.coalesce(F.octet_length(F.to_json(F.struct(*df.columns))), F.lit(0)) + _ROW
    n, total = df.limit(most + 1).agg(F.count("*"), F.sum(size.cast("long"))).first()
    return n <= most and (total or 0) <= limit


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows; else as it is, for a shuffled join."""
    return F.broadcast(df) if small_enough(df, limit) else df


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column is called so (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
