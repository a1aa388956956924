"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, with a partition for each batch, or for many folded into one. A batch is reduced to one row per digest
before any wide shuffle and dealt into the index's buckets, so the sort-merge join with the index moves the batch alone; the
digests that an anti-join with the index leaves are written as the batch's partition. Documents then look their
digest up among the batch's own answers.

A note beside the index has the bucket count, the partitions that are read and the batches that are in. A batch is visible once it is
noted, so one that was cut short does no harm, and one that is repeated under its name is answered alike and written over
itself. A partition has one sorted file for each bucket and is read in that order: no index row is shuffled or sorted for a batch.
When there are more than MOST_PARTS partitions they are folded into one. The folder of a folded partition stays for readers that
began before; it can be removed like any other.

Defined results
- Null text counts as empty. Null doc_id is a document of its own, smaller than every other.
- Rows that repeat both doc_id and text are one document, returned once; group_size counts every row of the batch.
- Of equal texts the largest doc_id stays; a text that another batch brought stays nowhere in this one, and keep_id is its row there.
- An empty batch gives an empty result and leaves the index as it is.
- Only the id and text columns are read, so other columns may have any name.
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, durable, free_name, keep_rows, new_path

NOTE = "number long, buckets int, parts array<string>, batches array<string>"
#: Partitions that a batch is compared with one after the other before they are folded.
MOST_PARTS = 8


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Inside, plans take a bucket of one file to be in the order in which it was written, as it is."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class DigestIndex:
    """(digest binary, keep_id long, group_size long, origin string, part string), bucketed and sorted by digest. origin is the
    batch that brought a digest, part the partition that it lies in now.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, most_parts: int = MOST_PARTS):
        self.spark, self.path, self.most_parts = spark, (path or new_path(spark, "digest_index")).rstrip("/"), most_parts
        if self._noted() is None:
            self._store(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), [], [])
        self.buckets, self.table = self._noted().buckets, "digest_index_" + uuid.uuid4().hex
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index has {self.buckets} buckets")
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT, origin STRING, part STRING) USING parquet PARTITIONED BY (part) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data'"
        )
        if self.parts():
            spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def _noted(self) -> Row | None:
        """The last note: the bucket count, the partitions that are read and the batches that are in."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/notes/_SUCCESS")
        if not where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
            return None
        return self.spark.read.schema(NOTE).parquet(f"{self.path}/notes").orderBy(F.desc("number")).first()

    def _store(self, buckets: int, parts: list[str], batches: list[str]) -> None:
        number = (self._noted() or Row(number=-1)).number + 1
        self.spark.createDataFrame([(number, buckets, parts, batches)], NOTE).coalesce(1).write.mode("append").parquet(f"{self.path}/notes")

    def batches(self) -> list[str]:
        return sorted(self._noted().batches)

    def parts(self) -> list[str]:
        """The partitions that the index is read from, of which there are most_parts and one at most."""
        return list(self._noted().parts)

    def rows(self) -> DataFrame:
        """The index as a bucketed table."""
        return self.spark.table(self.table).filter(F.col("part").isin(self.parts()))

    def close(self) -> None:
        """Take the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def answers(self, groups: DataFrame, batch: str) -> DataFrame:
        """groups (digest, keep_id, group_size) -> digest, keep_id, group_size, new. The index stays where it is.

        The batch meets one partition after the other, each a sorted file for each bucket, so that the batch alone is shuffled and sorted.
        """
        found = groups.repartition(self.buckets, "digest").withColumn("known_id", F.lit(None).cast("long")).withColumn("new", F.lit(True))
        for part in self.parts():
            known = self.spark.table(self.table).filter((F.col("part") == part) & (F.col("origin") != batch))
            known = known.select(F.col("digest").alias("known"), F.col("keep_id").alias("its_id"))
            met = F.col("known").isNotNull()
            found = found.join(known.hint("merge"), F.col("digest") == F.col("known"), "left")
            found = found.select("digest", "keep_id", "group_size", F.when(met, F.col("its_id")).otherwise(F.col("known_id")).alias("known_id"), (F.col("new") & ~met).alias("new"))
        return found.select("digest", F.when(F.col("new"), F.col("keep_id")).otherwise(F.col("known_id")).alias("keep_id"), "group_size", "new")

    def _write(self, rows: DataFrame, part: str, how: str = "OVERWRITE TABLE") -> None:
        """rows (digest, keep_id, group_size, origin) as a partition, over what an earlier try may have left there."""
        view = "new_" + uuid.uuid4().hex
        rows.select("digest", "keep_id", "group_size", "origin").repartition(self.buckets, "digest").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT {how} {self.table} PARTITION (part = '{part}') SELECT digest, keep_id, group_size, origin FROM {view}")
        self.spark.catalog.dropTempView(view)

    def append(self, answers: DataFrame, batch: str) -> None:
        """Write the new digests as the batch's partition, then note it; of a batch that was folded with others, what those lack."""
        parts, batches = self.parts(), self.batches()
        new = answers.filter("new").withColumn("origin", F.lit(batch))
        if batch in batches and batch not in parts:
            own = self.rows().filter(F.col("origin") == batch).select(F.col("digest").alias("own"))
            new = durable(new.join(own.hint("merge"), F.col("digest") == F.col("own"), "left_anti"), "digest_rest")
        self._write(new, batch)
        if batch not in parts:
            self._store(self.buckets, [*parts, batch], sorted({*batches, batch}))
        if len(self.parts()) > self.most_parts:
            self.fold()

    def fold(self) -> None:
        """Make one partition of all, so that files do not grow with the batches: each digest is written anew once in most_parts batches."""
        part = "folded-" + uuid.uuid4().hex
        self._write(self.rows(), part, "INTO")  # a name that no try had before
        self._store(self.buckets, [part], self.batches())

    def deduplicate(self, docs: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256: one row per document of the batch.

        batch names it (letters, digits, _ and -); without a name it is never the same batch again.
        """
        batch = batch or uuid.uuid4().hex
        if not all(c.isascii() and (c.isalnum() or c in "_-") for c in batch):
            raise ValueError(f"not a batch name: {batch!r}")
        rows = durable(digests(docs, id_col, text_col).groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "digests")
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
        groups = durable(groups, "digest_groups")  # else the join is pushed below the aggregate, and every copy is shuffled
        with sorted_buckets(self.spark):
            answers = durable(self.answers(groups, batch), "digest_answers")
        self.append(answers, batch)
        return rows.join(answers.hint("merge"), "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("new")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(ascii_lower(text), 256)).alias("digest"))


def exact_digest(docs: DataFrame) -> DataFrame:
    """The documents as one batch for an index of their own."""
    index = DigestIndex(docs.sparkSession)
    found = index.deduplicate(docs, "first")
    index.close()
    return found


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; repeated rows come back once."""
    digest = free_name(docs, "__digest")
    kept = exact_digest(docs).filter("kept").select("doc_id", F.unhex("text_sha256").alias(digest))
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn(digest, F.unhex(F.sha2(ascii_lower(text), 256)))
    return keep_rows(marked, kept, ["doc_id", digest], once_by=[]).drop(digest)
