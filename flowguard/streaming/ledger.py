"""Tables that grow batch by batch, by event date, with a filter of their keys in front.

Rows lie in folders ``event_date=…/batch_id=…``. A reader names the dates it needs, so a late row reads
its own date and nothing else, and no batch lists the folders of other dates. Batches of a date can be
compacted into one folder. Running a batch again rewrites its own folders only.

Keys of each date are kept in a blocked Bloom filter besides: a key has one block of 32,768 bits, in which
a few are set. Keys that the filter has never seen are new; only the others are looked up in the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowguard.operators.ledger import IDENTITY

#: Blocks of a date's filter, and bits that a key sets. 4,096 blocks of 4 KB hold some ten million
#: keys; with more of them the filter lets more through to the exact look-up.
BLOCKS, BITS = 4096, 5
BLOCK_BITS = 32_768


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path's constructor."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def dates_of(frame: DataFrame, *times) -> list[str]:
    """The dates that a frame's times fall on; few, whatever the rows."""
    days = F.explode(F.array(*[F.to_date(t) for t in times]))
    return [str(r[0]) for r in frame.select(days.alias("d")).distinct().collect() if r[0]]


class DatedTable:
    """Rows by event date and batch; ``time`` names the column that dates them."""

    def __init__(self, spark: SparkSession, path: str, time: str = "event_time"):
        self.spark, self.path, self.time = spark, path, time

    def write(self, frame: DataFrame, batch_id: int) -> None:
        dated = frame.withColumn("event_date", F.to_date(self.time)).withColumn(
            "batch_id", F.lit(batch_id).cast("long"))
        (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("event_date", "batch_id").parquet(self.path))

    def _parts(self, date: str) -> list[int]:
        fs, path = filesystem(self.spark, self.path)
        folder = path(f"{self.path}/event_date={date}")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return [int(n.split("=")[1]) for n in names if n.startswith("batch_id=")]

    def _current(self, date: str) -> list[int]:
        """The folders that make up a date: the last compacted one, and the batches after it.

        A compacted folder that holds all batches up to n has the number -n - 1.
        """
        parts = self._parts(date)
        upto = max((-p - 1 for p in parts if p < 0), default=None)
        later = [p for p in parts if p >= 0 and (upto is None or p > upto)]
        return ([] if upto is None else [-upto - 1]) + sorted(later)

    def dates(self) -> list[str]:
        """All dates; the only call that lists the table itself."""
        fs, path = filesystem(self.spark, self.path)
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(n.split("=")[1] for n in names if n.startswith("event_date="))

    def read(self, dates=None, before: int | None = None) -> DataFrame | None:
        """Rows of the given dates (all if none are given) from batches earlier than ``before``."""
        folders = [f"{self.path}/event_date={d}/batch_id={p}"
                   for d in sorted(set(self.dates() if dates is None else dates))
                   for p in self._current(d) if before is None or p < before]
        if not folders:
            return None
        return self.spark.read.option("basePath", self.path).parquet(*folders)

    def compact(self, dates, upto: int) -> None:
        """Puts the batches of these dates up to ``upto`` into one folder each, then drops theirs.

        Run it between batches: readers planned before may still want the old folders.
        """
        fs, path = filesystem(self.spark, self.path)
        for date in dates:
            old = [p for p in self._current(date) if p <= upto]
            if len(old) < 2:
                continue
            folder = f"{self.path}/event_date={date}"
            rows = self.spark.read.parquet(*[f"{folder}/batch_id={p}" for p in old])
            rows.write.mode("overwrite").parquet(f"{folder}/batch_id={-upto - 1}")
            for p in old:
                fs.delete(path(f"{folder}/batch_id={p}"), True)


def block_of(keys, blocks: int):
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")


def bits_of(keys):
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(BLOCK_BITS)) for i in range(BITS)])


def key_filter(rows: DataFrame, keys, blocks: int = BLOCKS) -> DataFrame:
    """(event_date, block, bits) of rows with an ``event_date``."""
    return (rows.select("event_date", block_of(keys, blocks).alias("block"),
                        F.explode(bits_of(keys)).alias("bit"))
            .groupBy("event_date", "block").agg(F.bitmap_construct_agg("bit").alias("bits")))


def may_hold(rows: DataFrame, filters: DataFrame, keys, blocks: int = BLOCKS) -> DataFrame:
    """Rows with ``_seen``: false where the filter rules the key out."""
    merged = filters.groupBy("event_date", "block").agg(F.bitmap_or_agg("bits").alias("_bits"))

    def is_set(bit):
        place = (F.floor(bit / 8) + 1).cast("int")
        octet = F.conv(F.hex(F.substring(F.col("_bits"), place, F.lit(1))), 16, 10).cast("int")
        return F.getbit(octet, (bit % 8).cast("int")) == 1
    return (rows.withColumn("block", block_of(keys, blocks))
            .join(merged, ["event_date", "block"], "left")
            .withColumn("_seen", F.coalesce(F.forall(bits_of(keys), is_set), F.lit(False)))
            .drop("block", "_bits"))


class Ledger(DatedTable):
    """A dated table that takes each key once, however late its repeats come."""

    def __init__(self, spark: SparkSession, path: str, keys=tuple(IDENTITY),
                 time: str = "event_time", blocks: int = BLOCKS):
        super().__init__(spark, f"{path}/rows", time)
        self.keys, self.blocks = list(keys), blocks
        self.filters = DatedTable(spark, f"{path}/filters", "event_date")

    def fresh(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Rows of a batch whose key no earlier batch has, one for each key.

        A repeat has the date of its first, since its time is part of its identity.
        """
        rows = batch.dropDuplicates(self.keys)
        dates = dates_of(rows, self.time)
        filters = self.filters.read(dates, before=batch_id)
        if filters is None:
            return rows
        judged = may_hold(rows.withColumn("event_date", F.to_date(self.time)), filters, self.keys,
                          self.blocks).drop("event_date")
        known = self.read(dates, before=batch_id).select(*self.keys)
        new = judged.where("NOT _seen").drop("_seen")
        asked = judged.where("_seen").drop("_seen")
        return new.unionByName(asked.join(known, self.keys, "left_anti"))

    def add(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """Stores what is new in a batch and returns it as stored; null if nothing is."""
        self.write(self.fresh(batch, batch_id), batch_id)
        stored = self.of_batch(batch_id, dates_of(batch, self.time))
        if stored is not None:
            self.filters.write(key_filter(stored, self.keys, self.blocks), batch_id)
        return None if stored is None else stored.drop("event_date", "batch_id")

    def of_batch(self, batch_id: int, dates) -> DataFrame | None:
        """What a batch stored under these dates."""
        folders = [f"{self.path}/event_date={d}/batch_id={batch_id}" for d in dates
                   if batch_id in self._parts(d)]
        return self.spark.read.option("basePath", self.path).parquet(*folders) if folders else None
