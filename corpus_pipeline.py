"""The corpus pipeline: stages over documents, each written to the shared folder and read again by the next.

Every stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents; the last adds, for every document
that is left, how many of its words the mix takes (0 where it takes none). ``mixed`` gives the corpus that this makes.

Defined results, by stage. A null or empty text scores as the classifier's bias says, equals other empty texts (white space of one or
more counts as a space), is near nothing, holds no benchmark words and has no words to take. A null id sorts last and is never near another; a
null source is a source of its own. Of equal rows one stays. Ties are settled by the smallest id. Texts of any length are read whole. Empty tables
give an empty result, documents without labels or benchmark are all clean by the stages that need these. Further columns pass through, save
that the last stage's (size, source_size, target, taken) replace any of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eddyline.llm import base, decontam, exact_dedup, mixing, near_dedup, toxicity
from eddyline.sources import scratch


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic; the classifier is fitted on labels that are not held out."""
    return toxicity.reject_toxic(docs, base.read(spark, sf_dir, "labels"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id stays."""
    return exact_dedup.exact_dedup(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), one stays."""
    return near_dedup.near_dedup(docs, size=5, percent=80)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item."""
    return decontam.decontaminate(docs, base.read(spark, sf_dir, "benchmark"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights: documents, and how much of each is taken."""
    return mixing.mix(docs, carry=True, labels=base.read(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact),
    ("near_dedup", _near),
    ("decontamination", _decontaminate),
    ("mixing", _mix),
]

#: The classifier of the first stage can't be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what stages wrote on the way, and all stages' results but the last, are gone by then."""
    docs = base.read(spark, sf_dir, "documents")
    with scratch.Scope(spark) as scope:
        for name, stage in STAGES:
            with scratch.Scope(spark) as inner:
                docs = base.written(stage(spark, docs, sf_dir), f"stage-{name}")
                inner.keep(docs)
        scope.keep(docs)
    return docs


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: documents as often as the mix takes them, the last copy cut to its words."""
    return mixing.repeated(run(spark, sf_dir))
