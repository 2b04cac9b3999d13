"""Near-duplicate detection by b-bit MinHash.

Method. A document's set is its distinct word shingles (64-bit hashes). 128 minima per set; bands
of four minima make bucket keys, as many bands as let a pair at the threshold miss all of them at
most once in 100,000. Of every minimum the two low bits are kept, packed into four longs. Sets that
are equal become one class before anything is paired. In each bucket every class is first
paired with the bucket's smallest one; pairs whose similarity, estimated from equal low bits and
corrected for chance collisions, is hopeless (six standard deviations below the threshold) go, and the others
are confirmed on the full sets. Connected components join what is linked. Where a bucket then
still holds several components, its members are compared across them too, under the same estimate and
confirmation, so that no link between members of a bucket is lost. This second round works in pairs of
blocks of bounded size, first over signatures alone: it yields who has any likely partner beyond its component there. Only their
sets are sent on, to be confirmed in the same pairs of blocks, and only links leave these tasks.

Scale. Texts are read twice, once for signatures and once for the sets of documents that share a
bucket; they are shuffled by id for that only where these are too many for every executor. Copies are summed within tasks before the shuffle. Buckets and centres with very many
members are joined through plain shuffled joins against written tables, whose large partitions
Spark splits; nothing collects a bucket. Work grows with the square of a group only where thousands of
texts are all nearly, but not quite, similar enough to link.

Defined results: null, empty and blank texts have an empty set and link with nothing; fewer words
than a shingle make one shingle; rows that share an id are one document for linking; a null id links with
nothing and is kept; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eddyline.llm import base, text_hash
from eddyline.llm.components import components
from eddyline.sources import scratch

MINIMA, ROWS, BITS = 128, 4, 2
MISSED = 1e-5
_A = np.random.default_rng(5).integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(6).integers(1, 1 << 63, MINIMA, dtype=np.uint64)
_BLOCK = 1024
#: Shingles of a block of set members that are compared with another in one task, at most.
BLOCK_SHINGLES = 500_000
#: Blocks that a bucket's members are dealt into at least, if that leaves each so many; and members of a block at most.
SPREAD, FEW, MANY = 4, 256, 4096


def bands_for(threshold: float) -> int:
    """So many bands that a pair at the threshold shares none with a probability of MISSED at most."""
    bands = math.ceil(math.log(MISSED) / math.log(1 - threshold**ROWS))
    if bands > MINIMA // ROWS:
        raise ValueError(f"{MINIMA} minima can't promise to find pairs of a similarity of {threshold}")
    return bands


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.uint64(0xFFFFFFFF), np.uint64)
    for i in range(0, len(s), _BLOCK):
        np.minimum(out, ((s[i : i + _BLOCK, None] * _A + _B) >> np.uint64(32)).min(axis=0), out=out)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima in MINIMA * BITS / 64 longs."""
    low = (m & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return (low << np.arange(0, 64, BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def slices(batch: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded amount of text each."""
    return (batch.slice(*part) for part in text_hash.slices(batch.column(text)))


def signatures(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """docs: id, text. Returns id, n, s1, s2 (a fingerprint of the set), k0.. (bucket keys), b0.. (packed bits)."""
    longs = MINIMA * BITS // 64
    names = ["n", "s1", "s2", *[f"k{i}" for i in range(bands)], *[f"b{i}" for i in range(longs)]]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out = np.zeros((batch.num_rows, len(names)), np.uint64)
                for row, s in zip(out, text_hash.shingle_sets(batch.column(1), size), strict=True):
                    row[0] = len(s)
                    if len(s):
                        m = minima(s)
                        row[1], row[2] = s.sum(dtype=np.uint64), text_hash.mixed(s ^ np.uint64(77)).sum(dtype=np.uint64)
                        key = np.arange(bands, dtype=np.uint64)
                        for r in range(ROWS):
                            key = text_hash.mixed(key * np.uint64(0xD6E8FEB86659FD93) + m[r : bands * ROWS : ROWS])
                        row[3 : 3 + bands] = key
                        row[3 + bands :] = packed(m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(np.ascontiguousarray(out[:, i]).view(np.int64)) for i in range(len(names))]], names=["id", *names]
                )

    return docs.mapInArrow(sign, f"id {docs.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """docs: id, text. Returns id, shingles (array of distinct hashes)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = [s.view(np.int64) for s in text_hash.shingle_sets(batch.column(1), size)]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0), arrays], names=["id", "shingles"])

    return docs.mapInArrow(hashed, f"id {docs.schema[0].dataType.simpleString()}, shingles array<long>")


def equal_minima(left: str, right: str) -> Column:
    """How many of the minima have equal low bits, from the packed longs."""
    total = F.lit(MINIMA)
    ones = F.lit(0x5555555555555555)
    for i in range(MINIMA * BITS // 64):
        x = F.col(f"{left}b{i}").bitwiseXOR(F.col(f"{right}b{i}"))
        total = total - F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(ones))
    return total


def similarity(left: str, right: str) -> Column:
    """The estimate: equal low bits, corrected for those that are equal by chance."""
    chance = 0.5**BITS
    return (equal_minima(left, right) / MINIMA - chance) / (1 - chance)


def hopeless_below(threshold: float) -> float:
    chance = 0.5**BITS
    p = chance + (1 - chance) * threshold
    return threshold - 6 * math.sqrt(p * (1 - p) / MINIMA) / (1 - chance)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a"
    )
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _blocks(members: DataFrame) -> DataFrame:
    """members: key, label, n and more; buckets that hold several labels. Adds g, a pair of blocks, and side.

    A bucket's most frequent label is held apart: its own members need no comparison. The others
    and it are dealt into blocks, at least one each; each pair of a block of others with any block
    is a g. Pairs are due across sides, and within side 0 of g's that end in d0.
    """
    by_label = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    tops = by_label.groupBy("key").agg(F.max(F.struct("c", "label", "n")).alias("top"), F.sum("n").alias("all"), F.sum("c").alias("members"))
    up = lambda x: F.ceil(x).cast("int")
    count = lambda c, n: F.greatest(up(n / BLOCK_SHINGLES), F.least(up(c / FEW), F.greatest(F.lit(SPREAD), up(c / MANY))))
    tops = base.written(
        tops.select(
            "key", F.col("top.label").alias("top"), count(F.col("top.c"), F.col("top.n")).alias("nd"), count(F.col("members") - F.col("top.c"), F.col("all") - F.col("top.n")).alias("no")
        ),
        "near-tops",
    )
    dealt = members.join(tops, "key").withColumn("other", F.col("label") != F.col("top"))
    dealt = dealt.withColumn("at", F.pmod(F.xxhash64("rep"), F.when(F.col("other"), F.col("no")).otherwise(F.col("nd"))).cast("int"))
    code = lambda i, j, side: F.struct(F.concat_ws(":", F.col("key").cast("string"), i.cast("string"), j).alias("g"), side.cast("int").alias("side"))
    count_from_0 = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    top_of = lambda j: F.concat(F.lit("d"), j.cast("string"))
    with_top = F.transform(count_from_0("nd"), lambda j: code(F.col("at"), top_of(j), F.lit(0)))
    with_others = F.transform(
        F.filter(count_from_0("no"), lambda k: k != F.col("at")),
        lambda k: code(F.least(k, F.col("at")), F.greatest(k, F.col("at")).cast("string"), F.col("at") > k),
    )
    of_top = F.transform(count_from_0("no"), lambda i: code(i, top_of(F.col("at")), F.lit(1)))
    to = F.when(F.col("other"), F.concat(with_top, with_others)).otherwise(of_top)
    return dealt.select("*", F.explode(to).alias("to")).select("*", "to.g", "to.side").drop("to", "top", "nd", "no", "other", "at")


class _Rows:
    """The rows of one pair of blocks, as arrays."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.side = np.array([r["side"] for r in rows])
        names = {x: i for i, x in enumerate(dict.fromkeys(r["label"] for r in rows))}
        self.label = np.array([names[r["label"]] for r in rows])
        self.n = np.array([r["n"] for r in rows])
        self.band = rows[0]["band"]
        self.keys = np.array([r["keys"] for r in rows], np.int64)
        self.bits = np.array([r["bits"] for r in rows], np.int64).view(np.uint64)
        #: Pairs within side 0 are due too.
        self.inside = rows[0]["g"].endswith(":d0")

    def likely(self, percent: int, cut: float) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of side 0, the rows of other labels that are due and may be similar enough by their signatures."""
        ones, chance = np.uint64(0x5555555555555555), 0.5**BITS
        for a in np.flatnonzero(self.side == 0):
            due = self.side == 1
            if self.inside:
                due |= (self.side == 0) & (np.arange(len(self.rows)) > a)
            to = np.flatnonzero(due & (self.label != self.label[a]) & (100 * np.minimum(self.n, self.n[a]) >= percent * np.maximum(self.n, self.n[a])))
            # each pair once: in the first of its common buckets
            to = to[~(self.keys[to, : self.band] == self.keys[a, : self.band]).any(axis=1)]
            x = self.bits[to] ^ self.bits[a]
            equal = MINIMA - np.bitwise_count((x | (x >> np.uint64(1))) & ones).sum(axis=1)
            estimate = (equal / MINIMA - chance) / (1 - chance)
            yield int(a), to[estimate >= cut]


def _partnered(rows: list[dict], percent: int, cut: float) -> Iterator[tuple]:
    """(g, rep) of the rows with a likely partner."""
    block, found = _Rows(rows), np.zeros(len(rows), bool)
    for a, to in block.likely(percent, cut):
        found[to] = True
        found[a] |= len(to) > 0
    for k in np.flatnonzero(found):
        yield rows[k]["g"], rows[k]["rep"]


def _linked(rows: list[dict], percent: int, cut: float) -> Iterator[tuple]:
    """Confirmed links (rep, rep) that join differing labels."""
    block = _Rows(rows)
    sets: dict[int, frozenset] = {}
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, to in block.likely(percent, cut):
        for b in to:
            x, y = find(block.label[a]), find(block.label[b])
            if x == y:
                continue
            for k in (a, b):
                if k not in sets:
                    sets[k] = frozenset(rows[k]["shingles"])
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (block.n[a] + block.n[b] - common):
                root[x] = y
                yield rows[a]["rep"], rows[b]["rep"]


def _in_blocks(dealt: DataFrame, columns: tuple[str, ...], each: Callable[[list[dict]], Iterator[tuple]], names: tuple[str, str]) -> DataFrame:
    """Runs a function over the rows of each g, which come together and are held in memory: two blocks at most."""
    types = [dealt.schema["g" if n == "g" else "rep"].dataType for n in names]
    schema = pa.schema([(n, to_arrow_type(t)) for n, t in zip(names, types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            found = list(each(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], schema.field(i).type) for i in (0, 1)], schema=schema)

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for row in whole.slice(at, 256).to_pylist():
                    if held and held[0]["g"] != row["g"]:
                        yield done()
                    held.append(row)
        if held:
            yield done()

    kinds = ", ".join(f"{n} {t.simpleString()}" for n, t in zip(names, types, strict=True))
    return dealt.select(*columns).repartition("g").sortWithinPartitions("g").mapInArrow(run, kinds)


def _links_in_blocks(dealt: DataFrame, sets: DataFrame, percent: int, cut: float) -> DataFrame:
    """dealt: what _blocks gives, with keys and bits. Returns links (a, b) that join differing labels.

    No pair leaves a task unless it is a link.
    """
    slim = ("g", "side", "rep", "label", "n", "band", "keys", "bits")
    partnered = base.written(_in_blocks(dealt, slim, lambda rows: _partnered(rows, percent, cut), ("g", "rep")), "near-partnered")
    whole = dealt.join(partnered, ["g", "rep"], "left_semi").join(sets.withColumnRenamed("id", "rep"), "rep")
    return _in_blocks(whole, (*slim, "shingles"), lambda rows: _linked(rows, percent, cut), ("a", "b"))


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, ident: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: the id, n_shingles, component_id, kept. size: words of a shingle;
    percent: the least similarity of a link."""
    base.ship(docs.sparkSession)
    texts = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    with scratch.Scope(docs.sparkSession) as scope:
        slim, placed = _placed(texts, size, percent)
        scope.keep(slim, placed)
    return (
        slim.select("id", "s1", "s2", "n")
        .join(placed, ["s1", "s2", "n"], "left")
        .withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
        .select(F.col("id").alias(ident), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def _placed(texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """texts: id, text. Two written tables: id, s1, s2, n of every row, and component_id by s1, s2, n."""
    threshold = percent / 100
    bands = bands_for(threshold)
    slim = base.written(signatures(texts, size, bands), "near-signed")
    keys, bits = [f"k{i}" for i in range(bands)], [f"b{i}" for i in range(MINIMA * BITS // 64)]
    # equal sets have equal keys and bits: any aggregate of numbers yields them, summed within tasks
    classes = base.written(
        slim.filter("n > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), *[F.min(c).alias(c) for c in keys + bits]),
        "near-classes",
    )
    buckets = classes.select("rep", "n", *bits, F.posexplode(F.array(*keys)).alias("band", "value")).withColumn("key", F.xxhash64("band", "value")).drop("value")
    centres = base.written(buckets.groupBy("key").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "near-centres")

    # sets of the classes that share a bucket with another
    shared = base.written(buckets.join(centres, "key", "left_semi").select(F.col("rep").alias("id")).distinct(), "near-shared")
    sets = base.written(full_sets(texts.join(base.sized(shared), "id", "left_semi"), size).dropDuplicates(["id"]), "near-sets")

    signed = lambda p: classes.select(F.col("rep").alias(p), F.col("n").alias(f"{p}_n"), *[F.col(c).alias(f"{p}_{c}") for c in bits])
    cut = hopeless_below(threshold)
    likely = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (similarity("a_", "b_") >= cut)
    pairs = buckets.select("key", F.col("rep").alias("b")).join(centres, "key").filter("a != b").select("a", "b").distinct()
    pairs = base.written(pairs.hint("merge").join(signed("b"), "b").join(signed("a").hint("merge"), "a").filter(likely).select("a", "b"), "near-pairs")
    links = base.written(_confirmed(pairs, sets, percent), "near-links")
    labels = base.written(components(links), "near-labels")

    # buckets that still hold several components
    labelled = buckets.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most").select("key")
    mixed = base.written(mixed, "near-mixed")
    rest = base.written(labelled.join(mixed, "key", "left_semi").select("key", "band", "rep", "label", "n"), "near-rest")
    every = classes.select("rep", F.array(*keys).alias("keys"), F.array(*bits).alias("bits"))
    more = base.written(_links_in_blocks(_blocks(rest).join(every, "rep"), sets, percent, cut), "near-more")
    if not more.isEmpty():
        labels = base.written(components(links.union(more)), "near-labels")

    placed = classes.select("s1", "s2", "n", "rep").join(labels, F.col("rep") == F.col("node"), "left")
    return slim, base.written(placed.select("s1", "s2", "n", F.coalesce("component", "rep").alias("component_id")), "near-placed")


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: of each group of near duplicates the one with the smallest id."""
    gone = near_duplicates(docs, size, percent, ident, text).filter("NOT kept").select(F.col(ident).alias("__gone")).distinct()
    gone = base.sized(base.written(gone, "near-gone"))
    return docs.join(gone, F.col(f"`{ident}`") == gone["__gone"], "left_anti")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(base.read(spark, sf_dir, "documents"), size=3, percent=85)


#: The plain meaning, by comparing all pairs that share a shingle; for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, ways.b FROM reached r JOIN ways ON ways.a = r.c),
placed AS (SELECT doc_id, min(c) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN placed p ON p.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
