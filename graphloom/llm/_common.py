"""What the operators of this subpackage share: reading, settling, safe joins, byte-level words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, \t, \n, \v, \f, \r. ``bytes.split()`` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast only if its counted rows stay under this bound; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes that continue a UTF-8 code point; code points = bytes that are not among these.
CONTINUATION = bytes(range(0x80, 0xC0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that driver and executors share: the session's spark.checkpoint.dir.

    A folder of our own is set only where the session names none and runs on one machine, as in tests; elsewhere that is
    an error, as executors would write to disks of their own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
        held = context._jsc.sc().getCheckpointDir()
    return (named or held.get()).rstrip("/")


class Scratch:
    """Tables written to the shared folder and read again, for loops.

    A table that is read again has the size of its files and no past, where a checkpoint hands on the constraints and the
    estimated size of the plan that it cut, which multiply from round to round.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.place, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.place}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def side(self, df: DataFrame, bound: int | None = None) -> DataFrame:
        """df kept; marked for broadcast if its counted rows are within the bound, else left to a shuffled join."""
        kept, bound = self.keep(df), BROADCAST_ROWS if bound is None else bound
        return F.broadcast(kept) if kept.count() <= bound else kept

    def forget(self, first: int, last: int) -> None:
        """Delete tables that nothing reads any more, by their numbers."""
        for i in range(first, last + 1):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{i}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; a lost executor then costs a re-read only. In loops Scratch serves instead."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, bound: int | None = None) -> DataFrame:
    """df settled; marked for broadcast if its counted rows are within the bound, else left to a shuffled join."""
    df, bound = settle(df), BROADCAST_ROWS if bound is None else bound
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of df's, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def each(values) -> Iterator:
    """The values of an Arrow array one by one, so that a batch of texts is not held twice."""
    return (v.as_py() for v in values)


def own(df: DataFrame) -> list[Column]:
    """All columns of df by their very names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key60(said: Column) -> Column:
    """60 bits of a string's MD5 as a long, which any SQL can repeat."""
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned from: crc32 of the id's text, remainder 1 by 3. Null ids count as text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1
