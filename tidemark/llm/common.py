"""What the operators of this package share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a Java character class body and as a string.
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[ \t-\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. A temporary one is made only in local
    mode (tests), where driver and executors are one process; on a cluster a session without that setting is an error."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not told and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="checkpoint-"))
    return told or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back: short lineage that survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: What a side that is broadcast may hold, and into how many parts a key is dealt where it may hold more.
BROADCAST_BYTES = 16 << 20
SALTS = 16
#: A key is hot if more than one in HOT of the rows have it; so at most HOT keys are.
HOT = 4096


def among(df: DataFrame, listed: DataFrame, key: str, spread: str) -> DataFrame:
    """The rows of df whose key is in the one long column of listed. It is broadcast if its counted size is
    within BROADCAST_BYTES; else each key is dealt into SALTS parts by the column spread, so a hot one isn't one task's."""
    if 16 * listed.count() <= BROADCAST_BYTES:
        return df.join(F.broadcast(listed), key, "left_semi")
    part = unused(df, "__part")
    return df.withColumn(part, _part(spread)).join(_in_parts(listed, part), [key, part], "left_semi").drop(part)


def among_counted(df: DataFrame, counted: DataFrame, key: str, spread: str) -> DataFrame:
    """The rows of df whose key is in counted(key, n), where n rows of df have the key; both columns are long. It is
    broadcast if its counted size is within BROADCAST_BYTES; else it is joined by key, and only hot keys, at most
    HOT, are dealt into parts by the column spread, so nothing is repeated for the others."""
    rows, total = counted.agg(F.count("*"), F.sum("n")).first()
    if 16 * rows <= BROADCAST_BYTES:
        return df.join(F.broadcast(counted.select(key)), key, "left_semi")
    part, parts = unused(df, "__part"), unused(df, "__parts")
    sized = counted.select(key, F.ceil(F.col("n") * HOT / F.lit(total)).cast("long").alias(parts))
    dealt = df.join(F.broadcast(sized.where(F.col(parts) > 1)), key, "left")
    dealt = dealt.withColumn(part, F.pmod(F.xxhash64(spread), F.coalesce(F.col(parts), F.lit(1).cast("long")))).drop(parts)
    listed = sized.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)).alias(part))
    return dealt.join(listed, [key, part], "left_semi").drop(part)


def told(df: DataFrame, known: DataFrame, key: str, spread: str) -> DataFrame:
    """df with the columns of known, which has one row of longs at most for a key; null where it has none. Broadcast
    or dealt as in ``among``."""
    if 16 * len(known.columns) * known.count() <= BROADCAST_BYTES:
        return df.join(F.broadcast(known), key, "left")
    part = unused(df, "__part")
    return df.withColumn(part, _part(spread)).join(_in_parts(known, part), [key, part], "left").drop(part)


def _part(spread: str) -> Column:
    return F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("long")


def _in_parts(df: DataFrame, part: str) -> DataFrame:
    return df.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is checkpointed within goes into a folder of its own in the shared one, which is removed at the end: for
    work whose result is written by then. Where the work fails, the folder stays."""
    base, sc = checkpoint_folder(spark), spark.sparkContext
    sc.setCheckpointDir(f"{base}/passing")  # Spark adds a folder of unique name
    made = sc._jsc.sc().getCheckpointDir().get()
    yield
    sc.setCheckpointDir(base)
    path = sc._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is never inlined, as a projected column may be."""
    return F.transform(F.array(value), body)[0]


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII white-space ones; empty for null."""
    bare = trimmed(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_CLASS + "+"))


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with the columns in new computed anew; others as they are, all in their order."""
    return df.select(*((new[c] if c in new else quoted(c)).alias(c) for c in df.columns))
