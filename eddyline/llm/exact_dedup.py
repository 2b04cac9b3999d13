"""Exact deduplication as a stateful stream.

Method. Each text is normalised and digested (SHA-256); slim rows (digest, batch, id, locator) go to an
inbox folder. A stream over that folder keeps, in disk-backed keyed state (RocksDB) that never
expires, one entry per digest: the first row seen (of a batch, that with the smallest id) with the locator of its content, and
the number of rows. Spark sums within each task before the shuffle, so a text that a third of all rows
share reaches the state as one row per task. What the stream puts out for a batch are the entries of that batch's digests, no others.
On hits (digests with more than one row so far) full bytes are compared: the contents of the batch's hit rows, and those of first rows
of earlier batches, read by their locators, are grouped by (digest, content), again summed within tasks first. Texts that share a digest
without being equal, should that ever happen, become groups of their own, over all batches.

Batches. State outlives a call: give ``state_dir`` again and later batches are matched against all earlier ones.
``batch`` names a batch. Given again, as after a driver was lost, it counts nothing twice and has the result that it had; one that
was left unfinished is finished before another is taken in. A locator is the file that a row came from and its id; rows that came from no file
(made in the session, or behind a shuffle) have their contents saved in the state_dir. Files that locators name have to stay.

Defined results: null equals the empty text; a row whose text came in an earlier batch is not kept, whatever its id; equal rows
with the same id each get a row of the assignment, and one of them stays; a null id sorts last; an empty table gives an empty table;
other columns pass through, save those that have an output's name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm import base
from eddyline.sources import scratch

OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256")
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "4",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # stores that are done with go soon
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no files laid out in advance
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """White space runs become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), base.BLANK, " ")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _first(*more: str) -> Column:
    """The first batch's smallest id, null last, with what belongs to its row."""
    return F.min(F.struct("batch", F.col("id").isNull().alias("missing"), "id", *more))


def _file(docs: DataFrame) -> Column:
    """The file that a row is from; empty where docs are of several tables, for which Spark can't tell."""
    try:
        docs.select(F.input_file_name())
    except AnalysisException:
        return F.lit("")
    return F.input_file_name()


class Inbox:
    """A state_dir: slim rows by batch, the stream's state, and what it put out for each batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def places(self) -> dict[str, int]:
        """The batches taken in, with their order."""
        return {n[9:]: int(n[:8]) for n in scratch.listed(self.spark, f"{self.path}/inbox")}

    def folder(self, kind: str, name: str) -> str:
        return f"{self.path}/{kind}/{self.places()[name]:08d}-{name}"

    def put(self, name: str, slim: Callable[[int], DataFrame]) -> None:
        """Takes in slim rows under a batch's name, if that is new: written elsewhere, then renamed."""
        if name in self.places():
            return
        place = max(self.places().values(), default=-1) + 1
        staged = f"{self.path}/staged/{name}"
        slim(place).write.mode("overwrite").parquet(staged)
        scratch.moved(self.spark, staged, f"{self.path}/inbox/{place:08d}-{name}")

    def rows(self, name: str | None = None) -> DataFrame:
        """A batch's slim rows, or those of all."""
        return self.spark.read.parquet(self.folder("inbox", name) if name else f"{self.path}/inbox/*")

    def unfinished(self) -> list[str]:
        return [n for n in self.places() if not scratch.complete(self.spark, self.folder("heads", n))]

    def finish(self, name: str) -> None:
        """Runs the stream over the one batch that it has not seen. What was run but not recorded runs again from the state before."""
        spark, to = self.spark, self.folder("heads", name)
        before = {k: spark.conf.get(k, None) for k in _CONF}
        for k, v in _CONF.items():
            spark.conf.set(k, v)
        try:
            inbox = spark.readStream.schema(self.rows(name).schema).parquet(f"{self.path}/inbox/*")
            heads = inbox.groupBy("digest").agg(_first("file").alias("head"), F.count(F.lit(1)).alias("n"))
            write = lambda df, _: df.write.mode("overwrite").parquet(to)
            heads.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{self.path}/state").trigger(
                availableNow=True
            ).start().awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def heads(self, name: str) -> DataFrame:
        """digest, head (batch, missing, id, file) and n of every digest of a batch, as they were after it."""
        return self.spark.read.parquet(self.folder("heads", name))

    def keep_contents(self, name: str, contents: DataFrame) -> None:
        """Saves the contents (id, content) of a batch whose rows came from no file."""
        to = self.folder("contents", name)
        if not scratch.complete(self.spark, to):
            contents.write.mode("overwrite").parquet(to)

    def keep_collided(self, name: str, digests: DataFrame) -> None:
        """Records digests that different contents share, if there are any."""
        if not digests.isEmpty():
            digests.write.mode("overwrite").parquet(self.folder("collided", name))

    def collided(self, before: int) -> DataFrame | None:
        found = [n for n in scratch.listed(self.spark, f"{self.path}/collided") if int(n[:8]) < before]
        return self.spark.read.parquet(*[f"{self.path}/collided/{n}" for n in found]).distinct() if found else None

    def located(self, wanted: DataFrame, ident: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
        """wanted: digest, batch, id, file. Returns digest, batch, id, content of what the locators name."""
        wanted = base.written(wanted.distinct(), "exact-wanted")
        batches = {place: name for name, place in self.places().items()}
        found = []
        files = sorted(r[0] for r in wanted.select("file").distinct().filter("file != ''").collect())  # as many as a scan lists
        if files:
            read = self.spark.read.parquet(*files).select(F.input_file_name().alias("f"), F.col(ident).alias("i"), normalised(F.col(text)).alias("content"))
            found.append(read.join(base.sized(wanted), (F.col("f") == F.col("file")) & F.col("i").eqNullSafe(F.col("id"))).select("digest", "batch", "id", "content"))
        for place in sorted(r[0] for r in wanted.filter("file = ''").select("batch").distinct().collect()):
            read = self.spark.read.parquet(self.folder("contents", batches[place])).withColumnRenamed("id", "i")
            found.append(read.join(base.sized(wanted.filter((F.col("batch") == place) & (F.col("file") == ""))), F.col("i").eqNullSafe(F.col("id"))).select("digest", "batch", "id", "content"))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out.filter(digest(F.col("content")) == F.col("digest"))


def assign(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    state_dir: str | None = None,
    digest: Callable[[Column], Column] = sha256,
    batch: str | None = None,
) -> DataFrame:
    """One slim row per row of docs: the id, keep_id, group_size, kept, text_sha256 (the digest).

    With the state_dir of earlier calls, groups reach back to their rows: sizes count
    them too, and a row whose text came before is not kept. batch: a name of these rows, of letters, digits and -; a new one by default.
    """
    spark, name = docs.sparkSession, batch or uuid.uuid4().hex
    inbox = Inbox(spark, state_dir or base.shared_path(spark, "exact-state"))
    for n in inbox.unfinished():
        inbox.finish(n)
    content = normalised(F.col(text))
    inbox.put(name, lambda place: docs.select(digest(content).alias("digest"), F.lit(place).alias("batch"), F.col(ident).alias("id"), _file(docs).alias("file")))
    rows, place = inbox.rows(name), inbox.places()[name]
    contents = docs.select(F.col(ident).alias("id"), content.alias("content"))
    if state_dir and not rows.filter("file = ''").isEmpty():
        inbox.keep_contents(name, contents)
    if name in inbox.unfinished():
        inbox.finish(name)
    heads = inbox.heads(name)

    many = heads.filter("n > 1").select("digest", "head")
    with scratch.Scope(spark) as scope:
        hits = base.written(rows.join(many.select("digest"), "digest", "left_semi").select(F.col("id").alias("hit")).distinct(), "exact-hits")
        # found by id, as ids spread evenly and digests do not
        found = contents.join(base.sized(hits), F.col("id").eqNullSafe(F.col("hit")), "left_semi")
        seen = found.select(digest(F.col("content")).alias("digest"), "content").distinct()
        earlier = many.filter(F.col("head.batch") < place).select("digest", "head.batch", "head.id", "head.file")
        if place and not earlier.isEmpty():
            seen = seen.union(inbox.located(earlier, ident, text, digest).select("digest", "content")).distinct()
        collided = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("digest")
        if known := inbox.collided(place):  # earlier, so that those count that came before
            collided = collided.union(heads.join(known, "digest", "left_semi").select("digest")).distinct()
        collided = base.written(collided, "exact-collided")
        scope.keep(collided)
    inbox.keep_collided(name, collided)

    mine = heads.select("digest", F.col("head.batch").alias("keep_batch"), F.col("head.id").alias("keep_id"), "n")
    out = rows.select("digest", "id").join(mine, "digest").select("id", "keep_batch", "keep_id", F.col("n").alias("group_size"), "digest")
    if not collided.isEmpty():
        every = inbox.rows().filter(F.col("batch") <= place).join(collided, "digest", "left_semi")  # of all batches so far
        odd = contents.withColumn("digest", digest(F.col("content"))).join(collided, "digest", "left_semi").withColumn("batch", F.lit(place)).select("digest", "batch", "id", "content")
        before = every.filter(F.col("batch") < place)
        if not before.isEmpty():
            odd = odd.unionByName(inbox.located(before.select("digest", "batch", "id", "file"), ident, text, digest))
        odd = base.written(odd, "exact-odd")
        by = odd.groupBy("digest", "content").agg(_first().alias("head"), F.count(F.lit(1)).alias("group_size"))
        told = odd.filter(F.col("batch") == place).join(by, ["digest", "content"])
        out = out.join(collided, "digest", "left_anti").unionByName(told.select("id", F.col("head.batch").alias("keep_batch"), F.col("head.id").alias("keep_id"), "group_size", "digest"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("keep_batch") == place)
    return out.select(F.col("id").alias(ident), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", state_dir: str | None = None, batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with their columns as they are.

    Decided over slim rows: texts are read past the few ids that go. Only rows whose id others have too are told apart by their texts.
    """
    decided = assign(docs, ident, text, state_dir, batch=batch).select(F.col(ident).alias("id"), "kept", F.col("text_sha256").alias("digest"))
    by = decided.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).filter("n > 1 OR NOT kept")
    by = base.written(by, "exact-decided")
    away = base.sized(by.select(F.col("id").alias("away")))
    out = docs.join(away, F.col(f"`{ident}`").eqNullSafe(away["away"]), "left_anti")
    again = base.sized(by.filter("n > 1").select(F.col("id").alias("again")))
    if again.isEmpty():
        return out
    pairs = decided.filter("kept").join(again, F.col("id").eqNullSafe(F.col("again")), "left_semi").select(F.col("id").alias("again"), "digest").distinct()
    pairs = base.written(pairs, "exact-again")
    own = base.spare(docs, "own")
    told = F.col(f"`{ident}`").eqNullSafe(pairs["again"]) & (F.col(own) == pairs["digest"])
    repeated = docs.withColumn(own, sha256(normalised(F.col(text)))).join(base.sized(pairs), told, "left_semi")
    return out.unionByName(repeated.dropDuplicates([ident, own]).drop(own))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return assign(base.read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, n.text_sha256 AS text_sha256 FROM n JOIN g USING (text_sha256)
"""
