"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Method. Every document gets the key -ln(u) / w with u a hash of its id in (0, 1) and w its quality
weight: from labels of quality by id, from 1/2 to 2 and 1 without a label, times a stand-in made of the mean length of words,
for corpora of which few documents are labelled. Documents sorted by key within a source form a weighted random order without replacement.
A source's token target first takes whole epochs of the source, then documents of that order until
the prefix sum reaches what remains; the document on that line gives the words up to it, so
that targets are met exactly. ``mix`` gives the counts, with the texts if asked to; ``mixed`` gives the mixed corpus.

Scale. One slim row per document (id, source, size, key) is written; texts are read once, and again where they are carried:
then only those in a bucket with a line are shuffled. Prefix
sums have two levels: keys fall into buckets of a fixed width of their logarithm, which other weights only shift, so that each holds
about 2 sqrt(n) of a source's n documents at most; bucket sums are added up in
order, and only the one bucket that a source's line crosses is sorted document by document. No
step gathers a source in one task, so a source with a third of all rows costs as much as any other.

Defined results: a null text has no words and takes none; a null source is a source of its own,
last in order; equal keys are ordered by id, then size; repeated rows count as documents of their
own; a corpus without words, or an empty table, takes nothing; columns of the input that have an
output's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyline.llm import base

OUTPUTS = ("size", "source_size", "target", "taken")
#: Quality weights are held between these.
LEAST, MOST = 1 / 16, 16.0
#: Up to so many sources, by count, their plan goes to every executor; beyond it is joined by a shuffle that may split.
SOURCES = 100_000


def quality(text: Column, size: Column) -> Column:
    """A weight from the mean length of the words: 1 at five characters, less the further off, 1/4 at least (as for texts without blanks)."""
    mean = F.octet_length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    return 1 / (1 + F.least(F.abs(mean - 6) / 6, F.lit(3.0)))


def rated(labels: DataFrame, ident: str, label: str) -> DataFrame:
    """rid, factor: a weight from 1/2 to 2 for every labelled id, by the mean of its labels from 0 to 1."""
    by = labels.groupBy(F.col(ident).alias("rid")).agg(F.avg(label).alias("q")).filter("rid IS NOT NULL AND q IS NOT NULL")
    return base.sized(base.written(by.select("rid", (0.5 + 1.5 * F.col("q")).alias("factor")), "mix-rated"))


def uniform(ident: Column, seed: int) -> Column:
    """A hash of the id in (0, 1): 52 bits of its MD5."""
    digest = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds target to sources (source, source_size), one row per source.

    Weights repeat over the sources in code-point order, null last. Targets share
    ``share`` times all sizes; none is above ``most`` times its source's size, and what lies above
    is shared anew by weight until none is. That ends where target = min(cap, level * weight) with one
    level for all: sources fill up in order of cap / weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("budget", share * F.sum("source_size").over(everything).cast("double"))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    )
    # the level is the one of the first source that does not fill up; all fill up if there is none
    return (
        levels.withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))))
        .select("source", "source_size", "target")
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    ident: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: Column | None = None,
    carry: bool = False,
    labels: DataFrame | None = None,
    label: str = "quality",
) -> DataFrame:
    """One row per document: the id, source, size in words, source_size, target and taken words.

    weight: a column of quality weights; quality() of the text where none is given. labels: a table of quality labels from 0 to 1, by ident, which
    scale the weights. carry: all input columns come along.
    """
    size = base.word_count(F.col(text))
    row = [F.struct(*[F.col(f"`{c}`") for c in base.fresh(docs, *OUTPUTS).columns]).alias("__row")] if carry else []
    sized = docs.select(F.col(ident).alias("id"), F.col(source).alias("source"), size.alias("size"), (quality(F.col(text), size) if weight is None else weight).alias("w"), *row)
    factor = F.lit(1.0)
    if labels is not None:
        sized = sized.join(rated(labels, ident, label), F.col("id") == F.col("rid"), "left")
        factor = F.coalesce("factor", F.lit(1.0))
    held = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.coalesce("w", F.lit(1.0)) * factor))
    keyed = sized.withColumn("key", -F.log(uniform(F.col("id"), seed)) / held).drop("w", "rid", "factor")
    slim = base.written(keyed.drop("__row"), "mix-slim")

    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = base.written(sources, "mix-sources")
    budget = targets(sources.select("source", "source_size"), weights, share, most)
    plan = (
        sources.select(F.col("source").alias("s"), "n")
        .join(budget, F.col("s").eqNullSafe(F.col("source")))
        .select(
            "s", "source_size", "target",
            F.ceil(F.sqrt("n") / 8).alias("buckets"),
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("epochs"),
        )
        .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    )
    plan = base.written(plan, "mix-plan")
    bucket = F.floor(F.log2("key") * F.col("buckets"))
    dealt = slim.join(base.sized(plan, SOURCES), F.col("source").eqNullSafe(F.col("s"))).withColumn("bucket", bucket)
    by_bucket = dealt.groupBy("s", "bucket", "rest").agg(F.sum("size").alias("held"))
    running = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    line = (
        by_bucket.withColumn("before", F.coalesce(F.sum("held").over(running), F.lit(0)))
        .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("held")))
        .select(F.col("s").alias("ls"), F.col("bucket").alias("line"), "before")
    )
    line = base.written(line, "mix-line")
    lined = plan.join(line, F.col("s").eqNullSafe(F.col("ls")), "left").drop("ls")
    in_plan = lambda rows: rows.join(base.sized(lined, SOURCES), F.col("source").eqNullSafe(F.col("s"))).withColumn("bucket", bucket).drop("s")
    placed = in_plan(keyed if carry else slim)
    # without a line the rest is nothing (target = epochs), or rounding left it at the source's size
    whole = F.when(F.col("line").isNull(), F.col("rest") > 0).otherwise(F.col("bucket") < F.col("line"))
    on_line = F.coalesce(F.col("bucket") == F.col("line"), F.lit(False))
    out = [*(["__row.*"] if carry else [F.col("id").alias(ident), F.col("source").alias(source)]), "size", "source_size", "target"]
    taken = lambda part: (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")
    away = placed.filter(~on_line).select(*out, taken(F.when(whole, F.col("size")).otherwise(0)))
    order = Window.partitionBy("source").orderBy("key", F.col("id").isNull(), "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    if carry:  # what the rows on a line give is known without their texts, which are then read once
        few = in_plan(slim).filter(on_line).withColumn("left", left)
        few = few.select(F.col("id").alias("lid"), F.col("source").alias("ls"), F.col("key").alias("lkey"), F.col("size").alias("lsize"), taken(F.greatest(F.lit(0), F.least("left", "size"))).alias("ltaken"))
        few = base.written(few, "mix-on-line")
        if few.groupBy("lid", "ls", "lkey", "lsize").count().filter("count > 1").isEmpty():  # equal rows are told apart by their order alone
            same = F.col("id").eqNullSafe(F.col("lid")) & F.col("source").eqNullSafe(F.col("ls")) & (F.col("key") == F.col("lkey")) & (F.col("size") == F.col("lsize"))
            plain = taken(F.when(whole, F.col("size")).otherwise(0))
            return placed.join(base.sized(few), same, "left").select(*out, F.coalesce("ltaken", plain).alias("taken"))
    # written first: then the join may split a large source, which the window above it would forbid
    there = base.written(placed.filter(on_line), "mix-on-line").withColumn("left", left).select(*out, taken(F.greatest(F.lit(0), F.least("left", "size"))))
    return away.unionByName(there)


def mixed(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixed corpus: options as mix() takes them. See repeated()."""
    return repeated(mix(docs, text=text, carry=True, **options), text)


def repeated(plan: DataFrame, text: str = "text") -> DataFrame:
    """What mix() with carry says, carried out: every document as often as it is taken, numbered by repeat from 1.

    The last copy is cut behind its last word where it is not taken whole; other columns, such as counts of
    characters, stay as they were. Documents of which nothing is taken are left out.
    """
    size, taken = F.col("size"), F.col("taken")
    columns = base.fresh(plan, *OUTPUTS, "repeat").columns
    copies = base.fresh(plan, "repeat").filter(taken > 0).withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(taken / size).cast("long"))))
    pieces = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each a word behind its blanks
    left = taken - (F.col("repeat") - 1) * size
    part = F.when(left >= size, F.col(text)).otherwise(F.array_join(F.slice(pieces, 1, F.greatest(F.lit(1), F.least(left, size)).cast("int")), ""))
    return copies.withColumn(text, part).select(*[F.col(f"`{c}`") for c in columns], "repeat")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, labels=base.read(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    strlen(coalesce(text, '')) AS bytes,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':17'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), rated AS (SELECT doc_id, 0.5 + 1.5 * avg(quality) AS factor FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), keyed AS (
  SELECT sized.*, -ln(u) / greatest(0.0625, least(16.0, 1 / (1 + least(abs(bytes / greatest(size, 1) - 6) / 6, 3)) * coalesce(factor, 1))) AS k
  FROM sized LEFT JOIN rated USING (doc_id)
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source
), ranked AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
    2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS budget FROM sources
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), level AS (SELECT arg_min(level, cap / w) AS l FROM levels WHERE cap >= level * w),
plan AS (
  SELECT source, source_size, coalesce(least(cap, l * w), cap) AS target FROM ranked, level
), spent AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM plan
), placed AS (
  SELECT doc_id, size, source_size, target, epochs, round(target - epochs * source_size)::BIGINT
    - coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY k, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
  FROM keyed k JOIN spent s ON k.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(remaining, size)))::BIGINT AS taken FROM placed
"""
