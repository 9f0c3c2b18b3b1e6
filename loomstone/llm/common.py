"""What the training-data operators share: reading tables, cutting lineage, row keys."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. The cluster names it in ``spark.checkpoint.dir``; only where that
    is unset (tests, one machine) a temporary one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="loomstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written tables in the shared folder. ``cut`` writes a frame and reads it back, so that what follows does not
    depend on executors that may be lost; ``drop`` deletes a table which no frame that is still wanted reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        root, files = self._files(self.root)
        files.mkdirs(root)
        files.deleteOnExit(root)  # what is not dropped before goes when the driver ends
        self.made: list[str] = []

    def _files(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        self.made.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loomstone_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_loomstone_path", None):
                p, files = self._files(path)
                files.delete(p, True)

    def keep_only(self, *frames: DataFrame) -> None:
        """Deletes all tables but these."""
        for path in {*self.made} - {getattr(df, "_loomstone_path", None) for df in frames}:
            p, files = self._files(path)
            files.delete(p, True)


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> list:
    """A 128-bit digest of a row's id and text, as the columns row_key and row_key2."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.xxhash64(F.lit("row_key2"), F.col(id_col), F.col(text_col)).alias("row_key2")]


ROW = ["row_key", "row_key2"]


def release() -> None:
    """Gives back to the system what Arrow's and C's allocators keep of memory that is free."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """A function of Arrow batches that gives back free memory after each and at its end: an idle worker holds little."""

    def wrapped(batches: Iterator) -> Iterator:
        def each() -> Iterator:
            for batch in batches:
                yield batch
                del batch
                release()

        try:
            yield from run(each())
        finally:
            release()

    return wrapped


def narrowed(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, most_bits: int = 25) -> DataFrame:
    """The rows of a large frame whose key may be in wanted, without moving them; see ``parted``. A join with wanted must
    follow; if wanted is so large that the map is full, all rows pass and that join does the work."""
    return parted(rows, key, wanted, wanted_key, most_bits)[0]


def parted(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, most_bits: int = 25) -> tuple[DataFrame, DataFrame]:
    """The rows of a large frame whose key may be in wanted, and those whose key is surely not, without moving them: a bit
    map of hashed keys, of 2 ** most_bits bits at most (half a million rows of 64 bits, some 21 MB as a hash table), is
    broadcast."""
    n = wanted.count()
    bits = min(most_bits, max(16, (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.lit(3), F.col(c)), F.lit(1 << bits))
    at = wanted.select(place(wanted_key).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("map_word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("map_bits"))
    r = rows.withColumn("map_place", place(key)).withColumn("map_word_of", F.shiftright("map_place", 6))
    hit = F.expr("coalesce((map_bits & shiftleft(1L, int(map_place & 63))) <> 0, false)")
    some = r.join(F.broadcast(words), F.col("map_word_of") == F.col("map_word")).where(hit)
    rest = r.join(F.broadcast(words), F.col("map_word_of") == F.col("map_word"), "left").where(~hit)
    return some.select(*rows.columns), rest.select(*rows.columns)


def any_row(df: DataFrame) -> bool:
    return bool(df.take(1))


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n; for a null id that of the empty text, 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def spread(rows: int, per: int) -> int:
    """In how many groups of about ``per`` rows so many rows go."""
    return max(1, math.ceil(rows / per))
