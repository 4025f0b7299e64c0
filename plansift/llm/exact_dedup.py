"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 digest of the text. A
batch is reduced to one row per digest, compared with the index by a sort-merge
anti-join, and the digests that are new are appended, so a later batch never
reads the texts of an earlier one again. A whole table is taken in several
batches, from the largest ids down, through an index of its own in the shared
folder.

A batch is written under a number drawn for the attempt and counts only once a
commit names that number, so rows that a lost run left behind are never seen.
A batch has a name: one that the caller gives, or a digest of its ids and
texts. A batch that was committed before is not added again; it is decided
anew against what was there before it, with the same result. The number of
buckets is kept beside the data.

Defined cases: null text counts as the empty text; rows that repeat the same
id and text count as copies and exactly one of them is kept; null ids come
last and count as the smallest; an empty batch gives an empty result and leaves
the index as it is; other columns of the input are never read, whatever their
names. One writer at a time.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.llm.rows import only_kept
from plansift.session import settle, shared_dir, small

#: Digests a bucket is meant to hold when the number of buckets is not given.
DIGESTS_PER_BUCKET = 4_000_000
#: Batches that a whole table is taken in.
BATCHES = 3
COMMITS = "run string, seq long, batch long"


def digest(text: Column) -> Column:
    """The SHA-256 of the text in UTF-8 as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


class DigestIndex:
    """Digests ``(digest, keep_id, batch)`` in buckets, sorted, under a path; it only grows.

    Beside the data lie the commits, a row for each batch that counts, and the
    number of buckets. Opening the path again continues the index; another
    number of buckets than it was made with is refused.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        held = self._made_with()
        if held and buckets and buckets != held:
            raise ValueError(f"the index at {self.path} has {held} buckets, not {buckets}")
        self.buckets = held or buckets or 16
        self.name = "digest_index_" + hashlib.md5(f"{self.path} {self.buckets}".encode()).hexdigest()
        if not held:
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/made")
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data'"
            )

    def _exists(self, part: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _made_with(self) -> int | None:
        return self.spark.read.parquet(f"{self.path}/made").first()[0] if self._exists("made") else None

    @property
    def commits(self) -> DataFrame:
        """``run, seq, batch``: the batches that count, in the order they were added."""
        if not self._exists("commits"):
            return self.spark.createDataFrame([], COMMITS)
        return self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")

    @property
    def table(self) -> DataFrame:
        """``digest, keep_id, seq`` of the batches that count."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).join(small(self.commits.select("batch", "seq")), "batch").select("digest", "keep_id", "seq")

    def append(self, groups: DataFrame, run: str) -> int:
        """Add the digests of ``groups (digest, keep_id)`` that the index lacks, as one batch; returns its place in order."""
        told = self.commits.filter(F.col("run") == run).agg(F.min("seq")).first()[0]
        if told is not None:
            return told
        seq, batch = (self.commits.agg(F.max("seq")).first()[0] or 0) + 1, uuid.uuid4().int >> 65
        self._write(groups.join(self.table.select("digest").hint("merge"), "digest", "left_anti"), batch)
        self._commit(run, seq, batch)
        return seq

    def _write(self, fresh: DataFrame, batch: int) -> None:
        (
            fresh.select("digest", F.col("keep_id").cast("long").alias("keep_id"), F.lit(batch).cast("long").alias("batch"))
            .repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def _commit(self, run: str, seq: int, batch: int) -> None:
        self.spark.createDataFrame([(run, seq, batch)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")


def buckets_for(rows: int) -> int:
    """Buckets for so many digests: 16 at least."""
    return max(16, -(-rows // DIGESTS_PER_BUCKET))


def open_index(spark: SparkSession, name: str, buckets: int | None = None) -> DigestIndex:
    """The index of that name in the shared folder, made if need be; it can be opened again in a later session."""
    return DigestIndex(spark, f"{shared_dir(spark).rstrip('/')}/plansift/index/{name}", buckets)


def counted_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, copies``, written: ids and digests, never texts."""
    return settle(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"))
        .groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")),
        "digests",
    )


def name_of(rows: DataFrame) -> str:
    """A name for a batch that follows from its ids and digests, in whatever order."""
    h = [F.xxhash64(F.lit(k), "digest", "doc_id", "copies") for k in (1, 2)]
    own = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.pmod(x, F.lit(1 << 52)).cast("decimal(38,0)")), F.lit(0)).alias(f"h{k}") for k, x in enumerate(h)]).first()
    return hashlib.md5(f"{own['n']} {own['h0']} {own['h1']}".encode()).hexdigest()


def _decided(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The verdicts of counted rows by ``held (digest, keep_id, group_size, known)``, copies told apart."""
    return (
        rows.join(held.hint("merge"), "digest")
        .select("doc_id", "keep_id", "group_size", "known", F.lower(F.hex("digest")).alias("text_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        .select("doc_id", "keep_id", "group_size", (~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256", "known")
    )


def exact_dedup(docs: DataFrame, index: DigestIndex, run: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decide for every row of ``docs``, one batch, whether it stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256, known``. Of equal
    texts within a batch the row with the largest id stays. A text that an
    earlier batch brought is dropped whole and ``keep_id`` names the earlier row
    (``known`` is true). ``group_size`` counts the rows of this batch with that
    text. The same batch under the same name is decided alike each time.

    Only ids and digests are shuffled, never texts. Copies are combined before
    the shuffle, so a text with many copies costs one row per task.
    """
    rows = counted_digests(docs, id_col, text_col)
    if rows.isEmpty():
        return _decided(rows, rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"), F.lit(False).alias("known")))
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    seq = index.append(groups.select("digest", "keep_id"), run or name_of(rows))
    # one row per digest on both sides; written, so that the last join can still split the rows of a hot digest
    held = settle(
        groups.drop("keep_id").join(index.table.filter(F.col("seq") <= seq).hint("merge"), "digest").withColumn("known", F.col("seq") < seq).drop("seq"), "held"
    )
    return _decided(rows, held)


def dedup_table(docs: DataFrame, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verdicts of :func:`exact_dedup` for a whole table: of equal texts the row with the largest id stays.

    The table goes through an index in the shared folder in batches of falling
    ids, so what an earlier batch brought is what stays. The index is named by
    the table's ids and texts: a run that is started again goes on where the
    lost one ended, and a table that was done is not added twice. ``known`` is
    false throughout: no row is older than the table.
    """
    spark = docs.sparkSession
    rows = counted_digests(docs, id_col, text_col)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(key, [k / batches for k in range(1, batches)] or [0.5], 1000).alias("cuts")).first()
    cuts = sorted(set(told["cuts"] or []), reverse=True)[: batches - 1]
    index = open_index(spark, name_of(rows), buckets_for(told["n"]))
    top: int | None = None
    for k, low in enumerate([*cuts, None]):
        own = F.lit(True) if low is None else key > low
        part = rows.filter(own if top is None else own & (key <= top))
        index.append(part.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), f"{k}")
        top = low
    sizes = rows.groupBy("digest").agg(F.sum("copies").alias("group_size"))
    held = settle(sizes.join(index.table.drop("seq").hint("merge"), "digest").withColumn("known", F.lit(False)), "held")
    return _decided(rows, held)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, all columns as they were."""
    verdict = settle(dedup_table(docs, id_col=id_col, text_col=text_col).select("doc_id", F.unhex("text_sha256").alias("mark"), "kept"), "verdict")
    return only_kept(docs, verdict, id_col, digest(F.col(text_col)))
