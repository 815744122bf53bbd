"""A training-corpus pipeline over ``documents``: five stages, each one corpus operator over all that its predecessor kept.

Every stage reads a stored table and all but the last return the columns of
``documents``. An empty table passes through; null texts stay null up to packing, where they are
empty documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import langid, nearcopies, packing, pii, suffix
from spanforge.llm.common import documents, materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go; a missing language is filled in, or stays missing where no row names one."""
    profiles = langid.fit_profiles(docs)
    if not profiles.names:
        letters = _unused(docs, "_letters")
        return langid.lettered(docs, out=letters).where(F.col(letters)).select(*docs.columns)
    lang, score = _unused(docs, "_lang"), _unused(docs, "_score")
    found = langid.identify(docs, profiles, lang_out=lang, score_out=score)
    kept = found.where(F.col(lang) != langid.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (SimHash candidates whose five-word shingles have a Jaccard likeness of 0.8 or more) the document of least id stays."""
    return nearcopies.keep_one(docs)


#: Bytes of a string that counts as repeated: passages of just over 50 words are longer in nearly all cases
#: (at sf0.1 98.9 % of the 51-word strings that documents share, on check_h 99.8 %).
PASSAGE_BYTES = 180


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of ``PASSAGE_BYTES`` that an earlier document, or an earlier place of the same one, has too are cut out: one copy of each stays.

    Documents of which nothing but white space is left go; those that were so before, and null texts, stay.
    """
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"\S") == F.lit(False)
    marked = docs.withColumn(_unused(docs, "was_blank"), blank)
    mark = marked.columns[-1]
    cut = suffix.remove_repeats(marked, window=PASSAGE_BYTES, first_stays=True)
    return cut.where(F.col(mark) | ~blank).select(*docs.columns)


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.redact(docs, pii.fit_tagger(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 tokens: a row for each piece of each document."""
    return packing.pack(materialise(packing.tokenised_pieces(docs), "pieces"))


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("suffix_dedup", repeats), ("personal_data", personal_data), ("packing", pack)]

#: No SQL expresses these stages; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
