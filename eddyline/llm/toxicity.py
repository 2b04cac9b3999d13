"""Toxicity by a counterfactual-regularised classifier.

Method. Logistic regression over words and word beginnings that a text has (each counts once
however often it occurs, so long texts are not worse than short ones). Features are the hashed
words and prefixes that tell labels apart best, by a smoothed log-odds z-score over the training rows, and those of all
identity terms. Every training text gives counterfactual pairs. One that mentions a group: itself, and itself with each
mention swapped for another of its kind. One that does not: itself, itself with a mention (which one, a hash says) put in,
and that with the mention swapped; the text with the mention is learned from as well, under the text's label. Squared changes of the
linear score within pairs are penalised, so that mentions of groups carry no weight of their own, in corpora without mentions too.

The fit uses at most ``sample`` labelled rows, those with the smallest hashed ids; scoring reads every text
whole. What reaches the driver is bounded by ``sample`` and ``features``.

Defined results: null and empty texts have no features and score as the bias says; several labels
of one id count by their mean, labels without a document or value not at all; without both labels
the score is the smoothed share of label 1; an empty table gives an empty table; columns
of the input that have an output's name are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.llm import base, text_hash
from eddyline.sources import scratch

SAMPLE, FEATURES = 12_000, 2048
PREFIXES = (4, 5, 6)
#: Words are runs of letters: ASCII letters and all bytes of other characters.
OUTSIDE = np.ones(256, bool)
OUTSIDE[65:91] = OUTSIDE[97:123] = OUTSIDE[128:] = False
_WORD = re.compile(r"[^\W\d_]+")
#: Groups of terms that are swapped for one another, in English, German, French and Spanish.
IDENTITIES = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "migrants"),
    ("disabled", "deaf", "blind", "autistic"),
    ("german", "french", "spanish", "english", "polish", "turkish", "chinese", "mexican"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "migranten"),
    ("behinderte", "gehörlose", "blinde", "autisten"),
    ("deutsche", "franzosen", "spanier", "engländer", "polen", "türken", "chinesen", "mexikaner"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme"),
    ("homosexuels", "hétérosexuels", "lesbiennes", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "migrants"),
    ("handicapés", "sourds", "aveugles", "autistes"),
    ("allemands", "français", "espagnols", "anglais", "polonais", "turcs", "chinois", "mexicains"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("mujer", "hombre"),
    ("homosexuales", "heterosexuales", "lesbianas", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "migrantes"),
    ("discapacitados", "sordos", "ciegos", "autistas"),
    ("alemanes", "franceses", "españoles", "ingleses", "polacos", "turcos", "chinos", "mexicanos"),
)


class Swaps:
    """Swaps mentions of identity terms, and says which to put in."""

    def __init__(self, groups: tuple[tuple[str, ...], ...] = IDENTITIES):
        self.next: dict[str, str] = {}
        for g in groups:
            for i, t in enumerate(g):
                self.next.setdefault(t, g[(i + 1) % len(g)])
        self.terms = sorted(self.next)

    def mentions(self, text: str) -> bool:
        return not self.next.keys().isdisjoint(_WORD.findall(text.lower()))

    def _put(self, m: re.Match) -> str:
        new = self.next.get(m[0].lower())
        if new is None:
            return m[0]
        return new.upper() if m[0].isupper() and len(m[0]) > 1 else new.capitalize() if m[0][0].isupper() else new

    def swapped(self, text: str) -> str:
        """The text with every term replaced by the next of its group, in the same case of first letter."""
        return _WORD.sub(self._put, text)

    def to_put_in(self, text: str) -> tuple[str, str]:
        """A term to put into a text, by a hash of it, and the term that this is swapped for."""
        term = self.terms[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(self.terms)]
        return term, self.next[term]


def present(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The features of texts: (text's place, feature), each once, sorted."""
    h, ends = text_hash.words(array, OUTSIDE, PREFIXES)
    row = np.repeat(np.arange(len(array)), np.diff(ends))
    row, h = np.repeat(row, h.shape[1]), h.ravel()
    row, h = row[h != 0], h[h != 0]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[first], h[first]


class Lookup:
    """Places of hashes in a sorted table; most others are turned away by their low bits."""

    def __init__(self, table: np.ndarray):
        self.table, self.known = table, np.zeros(1 << 16, bool)
        self.known[table & np.uint64(0xFFFF)] = True

    def found(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text's place, feature's place) of every known feature a text has, each once."""
        h, ends = text_hash.words(array, OUTSIDE, PREFIXES)
        width = h.shape[1]
        flat = h.ravel()
        at = np.flatnonzero(self.known[flat & np.uint64(0xFFFF)])
        if not len(self.table) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.table, flat[at]), len(self.table) - 1)
        hit = self.table[place] == flat[at]
        row = np.searchsorted(ends, at[hit] // width, "right") - 1
        both = np.unique(row * len(self.table) + place[hit])
        return both // len(self.table), both % len(self.table)


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    #: How many counterfactual pairs the penalty held together.
    pairs: int = 0

    def scores(self, array: pa.Array) -> np.ndarray:
        lookup, out = Lookup(self.features), []
        for start, n in text_hash.slices(array):
            row, place = lookup.found(array.slice(start, n))
            out.append(self.bias + np.bincount(row, self.weights[place], minlength=n))
        linear = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(linear, -60, 60)))


def _product(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values * w[cols], minlength=n)


def fitted(
    rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int,
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray, int], ridge: float = 3e-4, penalty: float = 5.0, steps: int = 600,
) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic regression, by Nesterov's accelerated gradient.

    rows, cols: a text's features. pairs: rows, columns, values and number of the differences
    between texts and their swapped versions.
    """
    n, (pr, pc, pv, m) = len(y), pairs
    ones = np.ones(len(cols))
    share = (y.sum() + 0.5) / (n + 1)
    w, b = np.zeros(width), float(np.log(share / (1 - share)))
    if not 0 < y.sum() < n:
        return w, b
    scale = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # the rarer label counts for more
    weight = 2 * penalty / m if m else 0.0

    def bent(u: np.ndarray, c: float) -> tuple[np.ndarray, float]:
        """What the loss bends by at most along (u, c)."""
        r = 0.25 * scale * (_product(rows, cols, ones, u, n) + c) / n
        g = np.bincount(cols, r[rows], minlength=width) + ridge * u
        if m:
            g += weight * np.bincount(pc, pv * _product(pr, pc, pv, u, m)[pr], minlength=width)
        return g, float(r.sum())

    # the largest bend, by power iteration; a step is its inverse
    u, c, most = np.full(width, (width + 1) ** -0.5), (width + 1) ** -0.5, 0.0
    for _ in range(40):
        u, c = bent(u, c)
        most = float(np.sqrt(u @ u + c * c))
        u, c = u / most, c / most
    step = 1 / (1.1 * most)
    v, c = w.copy(), b
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(_product(rows, cols, ones, v, n) + c, -60, 60)))
        r = (p - y) * scale / n
        g = np.bincount(cols, r[rows], minlength=width) + ridge * v
        if m:
            g += weight * np.bincount(pc, pv * _product(pr, pc, pv, v, m)[pr], minlength=width)
        nw, nb = v - step * g, c - step * r.sum()
        k = t / (t + 3)
        v, c, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    return w, b


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES,
    identities: tuple[tuple[str, ...], ...] = IDENTITIES, ident: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Model:
    """A model from at most sample of the rows that labels and docs share by id."""
    base.ship(docs.sparkSession)
    with scratch.Scope(docs.sparkSession):
        return _fit(docs, labels, sample, features, Swaps(identities), ident, text, label)


def _fit(docs: DataFrame, labels: DataFrame, sample: int, features: int, swaps: Swaps, ident: str, text: str, label: str) -> Model:
    chosen = (
        labels.groupBy(F.col(ident).alias("id")).agg(F.avg(label).alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
        .select("id", (F.col("y") >= 0.5).cast("int").alias("y"), F.xxhash64("id").alias("h"))
    )
    chosen = base.smallest(base.written(chosen, "toxic-labels"), F.col("h"), sample, "id").drop("h")
    # as many rows as sample says, so to every executor
    chosen = F.broadcast(base.written(chosen, "toxic-chosen"))
    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).join(chosen, "id").select("id", "y", "text")
    rows = base.written(rows, "toxic-rows")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in text_hash.slices(whole.column(2)):
                batch = whole.slice(*part)
                row, h = present(batch.column(2))
                y = batch.column(1).to_numpy(zero_copy_only=False)[row]
                kinds, place = np.unique(h, return_inverse=True)
                ones = np.bincount(place, y, minlength=len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds.view(np.int64)), pa.array(ones), pa.array(np.bincount(place, minlength=len(kinds)).astype(np.int64))], names=["f", "ones", "n"]
                )

    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    sums = rows.mapInArrow(counted, "f long, ones long, n long").groupBy("f").agg(F.sum("ones").alias("a"), (F.sum("n") - F.sum("ones")).alias("b"))
    rest = lambda k, total: F.lit(total + 1.0) - F.col(k)
    odds = F.log((F.col("a") + 0.5) / rest("a", ones)) - F.log((F.col("b") + 0.5) / rest("b", n - ones))
    z = F.abs(odds) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = sums.filter("a + b >= 3").select("f", z.alias("z")).filter("z >= 3").orderBy(F.desc("z"), "f").limit(features)
    best = base.written(best.select("f"), "toxic-features").collect()  # merged in a task, features of them
    table = np.array([r[0] for r in best], np.int64).view(np.uint64)
    table = np.unique(np.concatenate([table, present(pa.array(swaps.terms, pa.string()))[1]]))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(table)

        def sets(array: pa.Array) -> list[np.ndarray]:
            row, place = lookup.found(array)
            return np.split(place.astype(np.int32), np.searchsorted(row, np.arange(1, len(array)))) if len(array) else []

        # a term between words adds its own features to the text's
        of = dict(zip(swaps.terms, map(set, map(np.ndarray.tolist, sets(pa.array(swaps.terms, pa.string())))), strict=True))
        for whole in batches:
            for part in text_hash.slices(whole.column(2)):
                batch = whole.slice(*part)
                texts = batch.column(2).to_pylist()
                found = [bool(t) and swaps.mentions(t) for t in texts]
                others = iter(sets(pa.array([swaps.swapped(t) for t, m in zip(texts, found, strict=True) if m], pa.string())))
                rows = []
                for t, own, mention in zip(texts, sets(batch.column(2)), found, strict=True):
                    have = set(own.tolist())
                    if mention:
                        other = set(next(others).tolist())
                        rows.append((own, None, sorted(have - other), sorted(other - have)))
                    elif t and swaps.terms and _WORD.search(t):
                        first, second = (of[x] - have for x in swaps.to_put_in(t))
                        rows.append((own, sorted(first), sorted(first - second), sorted(second - first)))
                    else:
                        rows.append((own, None, None, None))
                lists = [pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["id", "y", "own", "put", "lost", "won"])

    # of each text its features; those of a mention that is put in; those that a swap loses and wins
    kind = rows.schema["id"].dataType.simpleString()
    lists = ", ".join(f"{c} array<int>" for c in ("own", "put", "lost", "won"))
    made = rows.mapInArrow(indexed, f"id {kind}, y int, {lists}").orderBy("id", "y", "own").toArrow()
    y, learned, pr, pc, pv, m = [], [], [], [], [], 0
    for label, own, put, lost, won in zip(*[made.column(c).to_pylist() for c in ("y", "own", "put", "lost", "won")], strict=True):
        y.append(label)
        learned.append(own)
        if put is not None:
            y.append(label)
            learned.append(own + put)
        for minus, plus in (() if lost is None else ((lost, won),) if put is None else ((lost, won), ((), put))):
            pr += [m] * (len(minus) + len(plus))
            pc += [*minus, *plus]
            pv += [1.0] * len(minus) + [-1.0] * len(plus)
            m += 1
    r = np.repeat(np.arange(len(learned)), [len(x) for x in learned])
    c = np.fromiter((i for x in learned for i in x), np.int64, len(r))
    w, bias = fitted(r, c, np.array(y, float), len(table), (np.array(pr, np.int64), np.array(pc, np.int64), np.array(pv), m))
    return Model(table, w, bias, m)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds each text's score, from 0 to 1."""
    base.ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = base.spare(docs, "__text")

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield pa.array(held.value.scores(array))

    return base.fresh(docs.withColumn(own, F.col(text)), name).withColumn(name, scores(own)).drop(own)


def fit_on_rest(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labels of rows that are not held out."""
    return fit(docs, labels.filter(~held_out(F.col("doc_id"))))


def reject_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The documents that score below most, with their columns as they are."""
    model, own = fit_on_rest(docs, labels), base.spare(docs, "__score")
    return score(docs, model, name=own).filter(F.col(own) < most).drop(own)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit_on_rest(docs, base.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
