"""Language identification of web pages by Bayesian evidence fusion.

Method. Four kinds of evidence about a page's language are multiplied. Text: hashed byte trigrams under a
multinomial model per language, fitted on documents whose language is known and tempered to
EFFECTIVE independent trigrams. Markup: the language that the page declares, in its html element's lang or xml:lang, or else a
meta element's content-language, or else og:locale. Address suffix: the top-level
domain and the first path segment where it is a code of two letters. Host: a prior from the other pages
of the host, smoothed towards its domain, which is smoothed towards the whole. How far markup and suffixes can be
trusted, and the priors, come from grouped sums of the text posteriors over all pages, so a site
that declares one language and writes another is not believed. A page's own posterior is taken out of its host's sums.

Scale. Every language that has labelled documents is kept. Of each, those documents are counted whose hashed id begins with
so many zero bits, as many as leave ``sample`` or more (about twice that at most); of a language with fewer, all. Trigrams have
BUCKETS buckets, halved until languages x buckets are at most CELLS, so the model's size is bounded and many languages cost
precision, not languages; a page's numbers are as many as there are languages. Evidence codes are at most 26 x 26 and a few more, so their tables go to every executor. Host and
domain sums are made within tasks first and joined by the host through a shuffle that Spark may split.

Defined results: a page without text, markup or address gets the prior; equal posteriors are settled by
the code's order; without labelled documents the language is null, and languages
without any are never an answer; several pages with one id are
rows of their own; an empty table gives an empty table; columns of the input that have an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.llm import base, text_hash
from eddyline.llm.html_extract import extract

SAMPLE, BUCKETS, CELLS = 4000, 1 << 16, 1 << 23
#: Numbers that are gathered at a time.
TILE = 1 << 21
EFFECTIVE = 40.0
#: Pseudo-counts: of evidence codes, and of a level of the host hierarchy by the level above.
SMALL, SHRINK = 0.5, 5.0
OUTPUTS = ("lang", "confidence", "text_lang", "declared", "suffix")


def trigrams(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of lower-cased texts, and the texts' places in them."""
    data, ends = text_hash.buffers(array)
    low = text_hash.LOWER[data].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    h = (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    # of the trigrams that begin in a text, the last two would cross its end
    begin = np.arange(len(h))
    fits = begin + 2 < ends[np.searchsorted(ends, begin, "right")]
    return h[fits].astype(np.int64), np.concatenate([[0], np.cumsum(fits)])[np.minimum(ends, len(h))]


def text_model(docs: DataFrame, sample: int = SAMPLE, ident: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of every bucket in each: buckets x languages."""
    hashed = F.xxhash64(F.col(ident), F.when(F.col(ident).isNull(), F.col(text)))
    zeros = F.lit(64) - F.length(F.bin(hashed))  # that a hash begins with
    known = docs.select(zeros.alias("zeros"), F.lower(F.col(lang)).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    held: dict[str, list[int]] = {}
    for r in known.groupBy("lang", "zeros").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 64 rows a language
        held.setdefault(r["lang"], [0] * 64)[r["zeros"]] = r["n"]
    langs = sorted(held)
    least = [max((k for k in range(64) if sum(held[x][k:]) >= sample), default=0) for x in langs]
    buckets = BUCKETS
    while buckets > 256 and buckets * len(langs) > CELLS:
        buckets //= 2
    drawn = docs.sparkSession.createDataFrame(list(zip(langs, range(len(langs)), least, strict=True)), "lang string, place long, least int")
    rows = known.join(F.broadcast(drawn), "lang").filter("zeros >= least").select("place", "text")  # one row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in text_hash.slices(whole.column(1)):
                batch = whole.slice(*part)
                h, ends = trigrams(batch.column(1))
                row = np.repeat(batch.column(0).to_numpy(), np.diff(ends))
                cell, n = np.unique(row * buckets + h % buckets, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    counts = np.full((buckets, len(langs)), 0.1)
    if langs:
        table = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most languages x buckets rows
        cell = table.column("cell").to_numpy()
        counts[cell % buckets, cell // buckets] += table.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


_META = r"(?i)<meta\s[^>]{0,400}?(?:content-language|og:locale)[^>]{0,400}>"


def markup(html: Column) -> Column:
    """The tags of a page that may declare its language: the html element's, and the first such meta elements'."""
    metas = F.slice(F.regexp_extract_all(html, F.lit(_META), F.lit(0)), 1, 4)
    return F.concat_ws("", F.regexp_extract(html, r"(?i)<html\b[^>]*>", 0), F.array_join(metas, ""))


def declared(tags: Column) -> Column:
    """The language code of two letters that tags, or a whole page, declare; empty if none is."""
    in_html = F.regexp_extract(tags, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2})(?![a-zA-Z])", 1)
    of = lambda name: r"(?i)<meta\s(?=[^>]{0,400}" + name + r")[^>]{0,400}?\bcontent\s*=\s*[\"']?\s*([a-zA-Z]{2})(?![a-zA-Z])"
    by_meta = [F.regexp_extract(tags, of(name), 1) for name in ("content-language", "og:locale")]
    out = F.lit("")
    for c in reversed([in_html, *by_meta]):
        out = F.when(c != "", c).otherwise(out)
    return out


def _code(c: Column) -> Column:
    """A code of two letters, or none."""
    c = F.lower(c)
    return F.when(c.rlike("^[a-z]{2}$"), c).otherwise("none")


def _normal(logs: np.ndarray) -> np.ndarray:
    """Rows of logarithms to probabilities that sum to 1."""
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


def likelihood(array: pa.Array, logs: np.ndarray) -> np.ndarray:
    """Tempered log-likelihoods of texts: texts x languages."""
    out, width = np.zeros((len(array), logs.shape[1])), max(1, TILE // logs.shape[1])
    for start, n in text_hash.slices(array):
        h, ends = trigrams(array.slice(start, n))
        h, size = h % len(logs), np.diff(ends)
        owner = np.repeat(np.arange(start, start + n), size)
        for at in range(0, len(h), width):
            own = owner[at : at + width]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[first]] += np.add.reduceat(logs[h[at : at + width]], first, axis=0, dtype=np.float64)
        out[start : start + n] *= np.minimum(1.0, EFFECTIVE / np.maximum(size, 1))[:, None]
    return out


def identify(
    pages: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", html: str = "html", url: str = "url"
) -> DataFrame:
    """Adds lang, confidence (its posterior), text_lang (by the text alone), declared and suffix."""
    base.ship(pages.sparkSession)
    langs, logs = model
    pages = base.fresh(pages, *(o for o in OUTPUTS if o not in (text, html, url)))
    aside = {c: base.spare(pages, f"aside{i}") for i, c in enumerate(pages.columns) if c.startswith("__") or c.endswith("_s")}
    if aside:  # names that are used in here
        out = identify(pages.withColumnsRenamed(aside), model, *(aside.get(c, c) for c in (text, html, url)))
        return out.withColumnsRenamed({new: old for old, new in aside.items()})
    host = F.lower(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]+)", 1))
    coded = pages.withColumns({
        "declared": F.coalesce(_code(declared(F.col(html))), F.lit("none")),
        "__host": F.coalesce(host, F.lit("")),
        "__tld": F.coalesce(_code(F.substring_index(host, ".", -1)), F.lit("none")),
        "__path": F.coalesce(_code(F.regexp_extract(F.col(url), r"^[^/]*//[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1)), F.lit("none")),
    }).withColumns({"__domain": F.substring_index("__host", ".", -2), "suffix": F.concat_ws("/", "__tld", "__path")})
    if not langs:
        return coded.drop("__host", "__tld", "__path", "__domain").withColumns({"lang": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "text_lang": F.lit(None).cast("string")})
    held, width = pages.sparkSession.sparkContext.broadcast(logs), len(langs)

    @F.arrow_udf("array<double>")
    def likelihoods(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Log-likelihoods, then posteriors by the text alone."""
        for array in batches:
            ll = likelihood(array, held.value)
            yield _lists(np.concatenate([ll, _normal(ll)], axis=1) if len(ll) else np.zeros((0, 2 * width)))

    seen = base.written(coded.withColumn("__lp", likelihoods(text)), "lang-seen")
    sums = F.array(*[F.sum(F.get("__lp", F.lit(width + i))) for i in range(width)]).alias("__sums")
    total = np.array([float(x or 0.0) + SMALL for x in seen.agg(sums).first()[0]])

    out = seen
    codes, levels = ("declared", "__tld", "__path"), ("__domain", "__host")
    for code in codes:
        # codes are two letters or none: at most 677 rows
        by = base.written(seen.groupBy(code).agg(sums), "lang-codes").withColumnRenamed("__sums", f"{code}_s")
        out = out.join(F.broadcast(by), code)
    for level in levels:
        by = base.written(seen.groupBy(F.col(level).alias("__level")).agg(sums), "lang-hosts").withColumnRenamed("__sums", f"{level}_s")
        out = out.join(by, F.col(level) == F.col("__level")).drop("__level")

    @F.arrow_udf("struct<lang: string, confidence: double, text_lang: string>")
    def fused(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        names = pa.array(langs, pa.string())
        for arrays in batches:
            lp, *by = (a.flatten().to_numpy().reshape(len(a), -1) if len(a) else np.zeros((0, 2 * width)) for a in arrays)
            x, own = lp[:, :width], lp[:, width:]
            by = [np.maximum(0.0, b[:, :width] - own) for b in by]  # without this page
            for others in by[: len(codes)]:
                x = x + np.log((others + SMALL) / (total + SMALL * 677))  # P(code | language)
            prior = total / total.sum()
            for others in by[len(codes) :]:
                prior = (others + SHRINK * prior) / (others.sum(axis=1, keepdims=True) + SHRINK)
            p = _normal(x + np.log(prior)) if len(x) else x
            best, by_text = (names.take(pa.array(q.argmax(axis=1))) for q in (p, own))
            yield pa.StructArray.from_arrays([best, pa.array(p.max(axis=1) if len(p) else [], pa.float64()), by_text], ["lang", "confidence", "text_lang"])

    return out.withColumn("__f", fused("__lp", *[f"{c}_s" for c in codes + levels])).select(*pages.columns, *[F.col("__f")[o].alias(o) if o in ("lang", "confidence", "text_lang") else o for o in OUTPUTS])


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    model = text_model(base.read(spark, sf_dir, "documents"))
    pages = extract(base.read(spark, sf_dir, "pages"), text="main", n_chars="main_chars").select("page_id", "url", markup(F.col("html")).alias("tag"), "main")
    return identify(pages, model, text="main", html="tag").select("page_id", "url", *OUTPUTS)
