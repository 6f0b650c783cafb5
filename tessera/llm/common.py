"""Shared pieces: table access, shared-folder tables, text rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java or RE2 character class body.
SPACE_CLASS = r"\x20\x09-\x0D"
#: The same characters as a literal, for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Bits a member and most bits of a membership filter; beyond that it lets more rows through, never fewer.
FILTER_BITS, FILTER_MOST, FILTER_HASHES = 12, 1 << 28, 3
#: Stands for a null doc_id.
NO_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session on one machine without that setting (a test) gets a folder of its own; on a cluster each executor
    would write to its own disk and a later read miss those files, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def keep(df: DataFrame, name: str = "t", few: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back; the table goes when the application ends.

    This cuts the lineage as a checkpoint does, survives lost executors, and stores columns compactly. ``few`` is for
    tables far smaller than what they are made of: their rows go to no more files than there are cores, as Hadoop's local
    file system starts a process (chmod) for every file, in which the writing executor stands twice until it is loaded."""
    spark = df.sparkSession
    if few:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def identified(docs: DataFrame) -> DataFrame:
    """whole (a struct of all columns, so that no name clashes), doc and th, the hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th"))


def membership(members: DataFrame, *cols: str) -> Callable[..., Column]:
    """A test of rows that is true for every member and false for most others: a Bloom filter over ``cols``, of a size
    that follows the members up to FILTER_MOST bits. It is put together on the executors; rows that it turns away
    needn't be shuffled to meet the members."""
    n = members.count()
    bits = min(FILTER_MOST, 1 << max(16, (n * FILTER_BITS).bit_length()))

    def places(of: tuple[Column, ...]) -> list[Column]:
        return [F.pmod(F.xxhash64(*of, F.lit(i)), F.lit(bits)) for i in range(FILTER_HASHES)]

    at = members.select(F.explode(F.array(*places(tuple(F.col(c) for c in cols)))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("set")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("set").to_numpy()
    shared = members.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def among(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        out = np.ones(len(a), bool)
        for at in (a, b, c):
            x = at.to_numpy()
            out &= (shared.value[x >> 6] >> (x & 63)) & 1 != 0
        return pd.Series(out)

    return lambda *of: among(*places(of))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with all its columns, but for the rows whose doc and th (see identified()) are in ``gone``. If ``gone``
    isn't small, only rows that may be in it are shuffled."""
    gone = keep(gone.select("doc", "th").distinct(), "gone", few=True)
    side, small = broadcast_if_small(gone, 200_000)
    rows = identified(docs)
    if small:
        return rows.join(side, ["doc", "th"], "left_anti").select("whole.*")
    among = membership(gone, "doc", "th")
    rows = rows.withColumn("maybe", among(F.col("doc"), F.col("th")))
    met = rows.where("maybe").join(side, ["doc", "th"], "left_anti")
    return rows.where("not maybe").select("whole.*").unionByName(met.select("whole.*"))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it is proven to have at most ``rows`` rows, else unhinted."""
    small = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if small else df.hint("merge")), small


def ascii_lower(c: Column | str) -> Column:
    """A-Z become a-z; every other character stays, so positions stay too."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the runs of non-space characters of a non-null string."""
    return F.filter(F.split(c, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def doc_hash_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow under one name, so that operators read alike."""
    return df.mapInArrow(fn, schema)


def fill(df: DataFrame, col: str, kind: str) -> DataFrame:
    """``col`` with nulls of ``kind`` replaced, whatever else the table holds."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit("").cast(kind)))
