"""Helpers that the operators share: reading tables, cutting lineage, word patterns."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shipped(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application, so that they need no installed copy and no common folder with the driver."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    if f"{package.name}.zip" not in context._python_includes:
        with zipfile.ZipFile(path := f"{tempfile.mkdtemp(prefix='tablero-')}/{package.name}.zip", "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of the folder."""
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPLIT = re.compile(WORD)
#: Latin-1 characters that Python's own split takes for white space, too.
_OTHER_GAPS = "\x1c\x1d\x1e\x1f\x85\xa0"


def words_of(text: str) -> list[str]:
    """The words of a text. Where it keeps to Latin-1 without other white space, Python's own split gives them faster."""
    try:
        text.isascii() or text.encode("latin-1")
    except UnicodeEncodeError:
        return _SPLIT.findall(text)
    return _SPLIT.findall(text) if any(c in text for c in _OTHER_GAPS) else text.split()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``. Where it is unset, a session on one machine (tests) gets a local one; a
    cluster is refused, since its nodes do not share local folders."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        named = "file://" + tempfile.mkdtemp(prefix="tablero-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The same rows, written as a Parquet table to the shared folder and read back: lineage ends here, a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(StructType(df.schema.fields)).parquet(path)


#: Keys that hold more than this part of all rows are joined apart: there are fewer of them than this number.
PARTS, FEW = 1024, 1000


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """An inner join with one row per key on the right (a written table), whose column ``count`` says how many of the ``total`` rows on the left have that
    key, or more.

    Keys with more than ``total / PARTS`` rows number fewer than ``PARTS``, whatever the size of the tables: that bounds the two broadcasts. Their rows stay
    where they are; all others meet in a plain join, in which no key is heavy. Without heavy keys that is the whole join.
    """
    heavy = F.col(count) > max(total // PARTS, FEW)
    hot = right.where(heavy)
    if hot.isEmpty():
        return left.join(right, keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(~heavy), keys)
    return rest.unionByName(left.join(F.broadcast(hot), keys))


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text column, a null text as the empty one; other columns cannot clash with what an operator adds."""
    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))


def sampled(df: DataFrame, size: int, *by: str) -> DataFrame:
    """At most ``size`` rows, those with the smallest digests of the named columns. A first cut by the digest leaves about four times as many, so
    that what the tasks send does not grow with their number."""
    share = min(1.0, 4 * size / max(1, df.count()))
    digest = F.xxhash64(*by)
    few = df if share == 1.0 else df.where(F.pmod(digest, F.lit(1_000_000_007)) < int(share * 1_000_000_007))
    return few.orderBy(digest, *by).limit(size)
