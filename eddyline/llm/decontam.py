"""Benchmark decontamination by winnowing.

Method. Texts are lower-cased (A-Z) and cut into words. Of every k consecutive words a hash is
taken; of every w consecutive such hashes the smallest is a fingerprint. A span of k + w - 1 words
that a document shares with a benchmark item has the same fingerprint in both, so joining
fingerprints finds every document that could hold a window of that many words. The hits are then
extended: the windows of the documents found are compared with the items' windows, word for word. Items
shorter than a window are one window of their own length, whose hash all documents' spans of
that length are held against (nothing is computed for lengths that no item has).

Scale. Only built-in functions; one scan gives both the documents' numbers of words and who of them has a fingerprint of an
item, in one slim row for each document. The items' fingerprints and windows go to every executor while they are few and
small enough (``base.sized``); beyond that the joins shuffle. A document's hits are places of distinct windows, however many
items share a window; which items these are is looked up once for each document and window.

Defined results: a null text, or one without words, is never hit; an item without words has no
window; equal items all count; rows that repeat an id are told apart by their texts; empty
tables give an empty table or no hits; columns of the input that have an output's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.llm import base
from eddyline.sources import scratch

WINDOW = 10
#: Words of a k-gram; fingerprints span WINDOW words, so WINDOW - K + 1 k-grams share one.
K = 5
OUTPUTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds __words. Splitting leaves an empty string before a leading and after a trailing separator."""
    split = df.withColumn("__split", F.split(base.ascii_lower(F.coalesce(F.col(text), F.lit(""))), _NOT_WORD))
    head = F.get("__split", F.lit(0)) == ""
    tail = (F.element_at("__split", -1) == "").cast("int")
    return split.withColumn(
        "__words", F.slice("__split", F.when(head, 2).otherwise(1), F.greatest(F.lit(0), F.size("__split") - head.cast("int") - tail))
    ).drop("__split")


def _grams(words: str, size: int) -> Column:
    """The hashes of all size consecutive words."""
    hashed = F.transform(F.col(words), lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, size)]))
    return F.slice(hashed, F.lit(1), F.greatest(F.lit(0), F.size(words) - (size - 1)))


def _fingerprints(grams: str) -> Column:
    """The smallest of every WINDOW - K + 1 consecutive hashes."""
    span = WINDOW - K + 1
    at = F.slice(grams, F.lit(1), F.greatest(F.lit(0), F.size(grams) - (span - 1)))
    return F.transform(at, lambda g, i: F.least(g, *[F.get(F.col(grams), i + k) for k in range(1, span)]))


def item_windows(items: DataFrame, ident: str, text: str) -> DataFrame:
    """item, size, win (the window's words), h (their hash): one row for each distinct window of an item."""
    worded = with_words(items.select(F.col(ident).alias("item"), F.col(text).alias("text"))).filter(F.size("__words") > 0)
    size = F.least(F.lit(WINDOW), F.size("__words"))
    spans = worded.withColumn("size", size).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("__words") - F.col("size") + 1)))
    win = spans.select("item", "size", F.slice("__words", F.col("at"), F.col("size")).alias("w"))
    hashed = F.lit(None).cast("long")
    for s in range(1, WINDOW + 1):
        hashed = F.when(F.col("size") == s, F.xxhash64(*[F.get("w", F.lit(k)) for k in range(s)])).otherwise(hashed)
    return win.select("item", "size", F.concat_ws(" ", "w").alias("win"), hashed.alias("h")).distinct()


def contaminated(
    docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document: the id and the columns of OUTPUTS."""
    docs = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).withColumn("own", F.xxhash64("text"))
    with scratch.Scope(docs.sparkSession) as scope:
        slim, hits = _found(docs, item_windows(items, item, item_text))
        scope.keep(slim, hits)
    out = slim.join(base.sized(hits), F.col("id").eqNullSafe(F.col("hid")) & (F.col("own") == F.col("hown")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        F.col("id").alias(ident),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("own").alias("__own"),
    )


def _found(docs: DataFrame, of_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: id, text, own. Two written tables: id, own, n_words and near of every row; hid, hown, n_hit and items of what is hit."""
    of_items = base.written(of_items, "decontam-items")
    windows = base.written(of_items.select("size", "win", "h").distinct().withColumn("wid", F.monotonically_increasing_id()), "decontam-windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most WINDOW values
    # windows of full size are known by the winnowed fingerprint of their words
    full = windows.filter(F.col("size") == WINDOW).select(F.split("win", " ").alias("w")).withColumn("g", _grams("w", K))
    prints = full.select(F.explode(_fingerprints("g")).alias("print")).union(windows.filter(F.col("size") < WINDOW).select("h"))
    prints = base.sized(base.written(prints.distinct(), "decontam-prints"))

    worded = with_words(docs.withColumn("row", F.monotonically_increasing_id())).withColumn("__grams", _grams("__words", K)).withColumn("n_words", F.size("__words").cast("long"))
    marks = [_fingerprints("__grams")] if WINDOW in sizes else []
    marks += [_grams("__words", s) for s in sizes if s < WINDOW]
    none = F.array().cast("array<bigint>")
    marked = worded.select("row", "id", "own", "n_words", F.explode_outer(F.array_distinct(F.concat(none, *marks))).alias("h"))
    # a row's marks come together, so they are summed within its task
    slim = marked.join(prints, F.col("h") == F.col("print"), "left").groupBy("row", "id", "own", "n_words").agg(F.max(F.col("print").isNotNull()).alias("near"))
    slim = base.written(slim.drop("row"), "decontam-slim")

    found = base.sized(slim.filter("near").select(F.col("id").alias("fid"), F.col("own").alias("fown")).distinct())
    near = with_words(docs.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("own") == F.col("fown")), "left_semi"))
    span_of = lambda s: lambda h, i: F.struct(i.alias("at"), F.lit(s).alias("span"), h.alias("hash"))
    spans = [F.transform(_grams("__words", s), span_of(s)) for s in sizes]
    none = F.array().cast("array<struct<at:int,span:int,hash:bigint>>")
    spans = near.select("id", "own", "__words", F.explode(F.concat(none, *spans)).alias("x")).select("id", "own", "__words", "x.*")
    # hashes find, words decide; as no equality, or every span would be put together for the join
    same = F.startswith(F.concat_ws(" ", F.slice("__words", F.col("at") + 1, F.col("span")), F.lit("")), F.concat("win", F.lit(" ")))
    hits = spans.join(base.sized(windows), (F.col("span") == F.col("size")) & (F.col("hash") == F.col("h")) & same)
    hits = base.written(hits.select("id", "own", "at", "size", "wid").distinct(), "decontam-places")
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))
    places = hits.groupBy("id", "own").agg(F.collect_set(F.struct("at", "size")).alias("spans")).select("id", "own", F.size(covered).cast("long").alias("n_hit"))
    by_window = base.sized(base.written(of_items.join(windows, ["size", "win", "h"]).select("wid", F.col("item").cast("string").alias("item")).distinct(), "decontam-by-window"))
    named = hits.select("id", "own", "wid").distinct().join(by_window, "wid").groupBy("id", "own").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = named.select(F.col("id").alias("hid"), F.col("own").alias("hown"), "items")
    both = places.join(named, F.col("id").eqNullSafe(F.col("hid")) & (F.col("own") == F.col("hown")))
    return slim, base.written(both.select("hid", "hown", "n_hit", "items"), "decontam-hits")


def decontaminate(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no window of any item."""
    bad = contaminated(docs, items, ident, text).filter("contaminated").select(F.col(ident).alias("__id"), "__own")
    bad = base.sized(base.written(bad.distinct(), "decontam-bad"))
    return docs.join(bad, docs[ident].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text]) == bad["__own"]), "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = base.read(spark, sf_dir, "documents"), base.read(spark, sf_dir, "benchmark")
    return contaminated(docs, items).drop("__own")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), b AS (
  SELECT item_id, w, least(10, len(w)) AS size FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM benchmark) WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b)
), sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)
), m AS (SELECT doc_id, i, dw.size AS size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
