"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams (lengths
1 to 3, word boundaries included) in order of frequency. A document's own list
is compared to each profile by the out-of-place distance: for each of the
document's n-grams the difference of ranks, or the profile's length where the
profile lacks it. The nearest profile wins; on a tie the smaller name.

Defined results: a null text, an empty text and a text without any letter give
``und`` with score 0. Without any labelled row every text gives ``und``.
Repeated rows are answered each. Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.common import GROUPS, append_columns, documents, fold, lean, literal_map, slices, smallest_hashes

UNKNOWN = "und"
_BITS = 21
_EDGE = np.uint32(0x5F)
#: Characters that are turned into n-grams at once while profiles are counted.
_BLOCK = 1 << 20

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def _codes(text: str | None) -> np.ndarray | None:
    """Lower-case letters with one edge mark for each run of anything else, and at both ends."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letter_table()[points]
    if not letter.any():
        return None
    points = np.concatenate(([_EDGE], np.where(letter, points, _EDGE), [_EDGE]))
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != _EDGE) | (points[:-1] != _EDGE)
    return points[keep].astype(np.uint64)


def _grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams of lengths 1 to 3 as packed integers; the bare edge mark is none."""
    bits = np.uint64(_BITS)
    two = (codes[:-1] << bits) | codes[1:]
    three = (two[:-1] << bits) | codes[2:]
    return np.concatenate((codes[codes != _EDGE], two, three))


def _ranked(grams: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, by count and then by code."""
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    counts = np.diff(np.append(first, len(grams)))
    if len(first) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        at = counts >= least
        first, counts = first[at], counts[at]
    order = np.argsort(-counts, kind="stable")[:size]
    return grams[first[order]]


class Profiles:
    """Ranked n-grams by language, ready for comparison."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.size = size
        self.names = sorted(ranked)
        self.grams = np.array(sorted({g for v in ranked.values() for g in v}), dtype=np.uint64)
        self.ranks = np.full((len(self.names), max(1, len(self.grams))), -1, dtype=np.int64)
        for i, name in enumerate(self.names):
            at = np.searchsorted(self.grams, np.array(ranked[name], dtype=np.uint64))
            self.ranks[i, at] = np.arange(len(at))

    def distances(self, text: str | None) -> np.ndarray | None:
        codes = _codes(text)
        if codes is None or not self.names:
            return None
        own = _ranked(_grams(codes), self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        ranks = self.ranks[:, at]
        apart = np.abs(ranks - np.arange(len(own)))
        return np.where(known & (ranks >= 0), apart, self.size).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.distances(text)
        if found is None:
            return UNKNOWN, 0.0
        best = int(found.argmin())
        if len(found) == 1:
            return self.names[0], 1.0
        rest = int(np.delete(found, best).min())
        total = rest + int(found[best])
        return self.names[best], rest / total if total else 0.5


def fit_profiles(docs: DataFrame, train=None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 1000, size: int = 300) -> Profiles:
    """Profiles of every language of ``lang_col``.

    Learns from at most ``sample`` documents of each language (those with the
    smallest hash of the id; documents with equal hashes stay together), read
    whole. ``train`` is a boolean column that says which rows may be learned
    from. The counts are made by the executors; the driver gets ``size`` rows a
    language.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"), (F.lit(True) if train is None else train).alias("u")).where("u and l is not null").withColumn("h", F.xxhash64("i"))
    limits = smallest_hashes(rows.select("l", "i"), "l", "i", sample).groupBy("l").agg(F.max(F.xxhash64("i")).alias("top"))
    tops = {r["l"]: r["top"] for r in limits.limit(GROUPS + 1).collect()}
    if not tops:
        return Profiles({}, size)
    if len(tops) <= GROUPS:
        # the texts are sifted where they are read
        chosen = rows.where(F.col("h") <= F.element_at(literal_map(tops), F.col("l"))).select("l", "t")
    else:
        chosen = rows.join(limits, "l").where("h <= top").select("l", "t")

    def count(batches):
        for whole in batches:
            for batch in slices(whole):
                yield from _count(batch)

    def _count(batch):
        import pyarrow as pa

        held: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (codes := _codes(text)) is not None:
                held.setdefault(lang, []).append(_grams(codes))
        for lang, parts in held.items():
            grams, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["l", "g", "n"])

    counts = chosen.mapInArrow(lean(count), "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("l").orderBy(F.desc("n"), "g")
    ranked: dict[str, list[int]] = {}
    for row in counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= size).orderBy("l", "r").collect():
        ranked.setdefault(row["l"], []).append(row["g"])
    return Profiles(ranked, size)


def identify(docs: DataFrame, profiles: Profiles, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the predicted language and a score from 0 to 1.

    The score is the second distance's share of the two smallest, so 0.5 is a
    tie. The profiles travel with the function: languages x ``size`` integers.
    """

    def make():
        def predict(texts):
            found = [profiles.predict(t) for t in texts]
            return [[f[0] for f in found], [f[1] for f in found]]

        return predict

    return append_columns(docs, text_col, [(lang_out, T.StringType()), (score_out, T.DoubleType())], make)


def lettered(docs: DataFrame, *, text_col: str = "text", out: str = "letters") -> DataFrame:
    """All rows and columns of ``docs`` with whether the text has any letter, which needs no profile."""

    def make():
        return lambda texts: [[_codes(t) is not None for t in texts]]

    return append_columns(docs, text_col, [(out, T.BooleanType())], make)


def op10_language_id(spark, sf_dir):
    """Contract query: profiles from the folds other than 2 of 4, predictions for every row."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    profiles = fit_profiles(docs, fold(F.col("doc_id"), 4) != 2)
    rows = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))
    return identify(rows, profiles).drop("text")
