"""What the training-data operators share: text columns, word splitting, the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Java patterns of what stands between words.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset on a local master (tests), a new temporary one, set for
    the session.  A cluster has to name one: a temporary folder would be another one on each machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder if "://" in folder or folder.startswith("file:") else "file://" + folder


_made: list[list[str]] = []  # folders made since each cleaned() began


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _made:
        made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[set[str]]:
    """Removes the tables that were written within it to the shared folder, but those whose paths are put into the set."""
    made, kept = [], set()
    _made.append(made)
    try:
        yield kept
    finally:
        _made.remove(made)
        for path in made:
            if path not in kept:
                remove(spark, path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A query that runs within it leaves no shuffle files once it has ended; else they stay until the driver happens to
    collect its garbage.  A frame that is run again within it makes its shuffles again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives any executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def drop(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.written_to)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str, heavy: int = 1000, ways: int = 256) -> DataFrame:
    """left joined to right by ``on``, of which right holds each value once, with hot values dealt over many tasks.

    right's ``weight`` says how many rows of left a value meets.  The ``heavy`` largest values are broadcast (so many rows
    at most): their rows of left are dealt over ``ways`` parts by a hash of the row, and right's row goes to each part.
    Any value outside them has at most 1 / heavy of the rows.  right is read twice and should be a written table.
    """
    top = F.broadcast(right.where(F.col(weight) >= 2 * ways).orderBy(F.desc(weight), *on).limit(heavy).select(*on, F.lit(True).alias("__hot")))
    part = F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(ways))).otherwise(F.lit(0)).cast("int")
    parts_ = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(top, on, "left").withColumn("__part", part).drop("__hot")
    given = right.join(top, on, "left").withColumn("__part", F.explode(parts_)).drop("__hot", weight)
    return dealt.join(given, [*on, "__part"], how).drop("__part")


def whole(col: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; plain lower() does that to texts that are all ASCII, and much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row, whatever the optimiser merges."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parts(text: Column, separators: str) -> Column:
    """The pieces of text between runs of separators, without empty ones at the ends."""
    return let(F.split(text, separators), lambda a: F.filter(a, lambda x: F.octet_length(x) > 0))


def n_parts(text: Column, separators: str) -> Column:
    """How many pieces parts() gives, without building them twice: only the first and the last can be empty."""
    empty = lambda a, i: (F.octet_length(F.element_at(a, i)) == 0).cast("int")
    return let(F.split(text, separators), lambda a: F.greatest(F.size(a) - empty(a, 1) - empty(a, -1), F.lit(0)).cast("long"))


def alnum_words(text: Column) -> Column:
    return parts(text, NOT_ALNUM)


def space_words(text: Column) -> Column:
    return parts(text, SPACES)


def text_key(*cols: Column) -> Column:
    """A 128-bit digest, as a struct, by which equal rows are known again."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(7), *cols).alias("b"))


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable bytes as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def open_path(uri: str):
    """(file system, path) of a folder that Spark wrote, for tasks that read or write files themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
