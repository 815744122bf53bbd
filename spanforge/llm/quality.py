"""Quality rules whose cutoffs come from risk control.

Base measures are counted over each whole text. The method then chooses, for
each stratum (the document's language) and each rule, the strictest cutoff of a
fixed grid whose false-rejection rate on labelled good documents is certified:
the exact (Clopper-Pearson) upper binomial bound on that rate must not exceed
the rule's share of ``risk``. The confidence is divided by the number of
(stratum, rule) pairs; along a grid the cutoffs are tested from lenient to strict
and testing ends at the first that fails, so the chance that any chosen cutoff
breaks its limit is at most ``delta``. No cutoff is fitted, so every labelled
row serves as holdout. A stratum with too few labels for any rule's share has its whole rule set certified at
``risk`` instead: the rules tighten in turn along one fixed path, and what any of them rejects is tested.
The query gives each of the two ways half of ``delta``. A stratum without enough evidence for either rejects nothing.

Defined results: null text counts as no words; ``base_failed`` is true for it.
A null stratum is the stratum ``''``; strata without labels keep what passes
the base. Labels with a null id or null quality are ignored; repeated labels
count each time; labels without a document are ignored. Non-UTF-8-safe input
does not occur: Spark strings are passed on as bytes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.common import append_columns, documents, materialise

BASE = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType())]

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: Grids from lenient to strict; a document is rejected by a rule at or beyond its cutoff.
RULES: dict[str, list[float]] = {
    "symbols": [3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeats": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "long_words": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.5, 9.0],
    "short_words": [-1.5, -2.0, -2.25, -2.5, -2.75, -3.0, -3.25, -3.5],
}


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a ``width``-word window that occurs twice or more in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*[words[i:] for i in range(width)]))
    if len(set(windows)) == n:
        return 0
    seen: dict[tuple, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in windows), dtype=np.int64, count=n)
    twice = np.bincount(codes)[codes] > 1
    covered = np.zeros(len(words), dtype=bool)
    for i in range(width):
        covered[i : i + n] |= twice
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    points = np.frombuffer(text, dtype=np.uint8)
    words = text.split()
    chars = int(((points & 0xC0) != 0x80).sum() - _SPACE[points].sum())
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(words), chars, int(_SYMBOL[points].sum()), len(lines) - len(set(lines)), repeated_words(words)


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns with the five base measures."""

    def make():
        return lambda texts: [list(x) for x in zip(*map(measure, texts))] if texts else [[] for _ in BASE]

    return append_columns(docs, text_col, BASE, make, as_bytes=True)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_values(lines: str = "n_dup_lines") -> dict:
    """Each rule's value of a measured row: the higher, the worse."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col(lines) * 8 / words,
        "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": -(F.col("word_chars") / words),
    }


def upper_bound(bad: int, n: int, delta: float) -> float:
    """The exact upper confidence bound on a binomial rate: the p with P(X <= bad; n, p) = delta."""
    if n == 0 or bad >= n:
        return 1.0
    steps = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(bad + 1)]

    def below(p: float) -> float:
        terms = [s + i * math.log(p) + (n - i) * math.log1p(-p) for i, s in enumerate(steps)]
        top = max(terms)
        return math.exp(top) * sum(math.exp(t - top) for t in terms)

    low, high = bad / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid <= 0 or below(mid) > delta:
            low = mid
        else:
            high = mid
    return high


def certify(counts: dict[tuple[str, str], tuple[int, list[int]]], risk: float = 0.02, delta: float = 0.05) -> dict[tuple[str, str], float]:
    """The strictest certified cutoff by (stratum, rule).

    ``counts`` has, for each pair, the number of good documents and how many of
    them each grid cutoff would reject.
    """
    found = {}
    limit, share = risk / len(RULES), delta / max(1, len(counts))
    for (stratum, rule), (n, rejected) in counts.items():
        for cutoff, bad in zip(RULES[rule], rejected):
            if bad > limit * n or upper_bound(bad, n, share) > limit:
                break
            found[(stratum, rule)] = cutoff
    return found


def holdout_counts(measured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", stratum_col: str = "lang", quality_col: str = "quality") -> dict:
    """Good documents and rejections by grid cutoff, counted by the executors; the driver gets strata x rules rows."""
    good = labels.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull() & (F.col(quality_col) == 1))
    values = rule_values()
    joined = measured.where(~base_failed()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("_s"), *[v.alias(r) for r, v in values.items()]).join(good, "_id")
    sums = [F.count("*").alias("n")] + [F.sum((F.col(r) >= c).cast("long")).alias(f"{r}_{i}") for r, grid in RULES.items() for i, c in enumerate(grid)]
    return {(row["_s"], r): (row["n"], [row[f"{r}_{i}"] for i in range(len(grid))]) for row in joined.groupBy("_s").agg(*sums).collect() for r, grid in RULES.items()}


#: All rules' cutoffs as one path: the rules tighten in turn, each by its share of its own grid.
PATH = [(rule, cutoff) for _, _, rule, cutoff in sorted(((i + 1) / len(grid), k, rule, cutoff) for k, (rule, grid) in enumerate(RULES.items()) for i, cutoff in enumerate(grid))]


def path_counts(measured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", stratum_col: str = "lang", quality_col: str = "quality") -> dict[str, dict[int, int]]:
    """By stratum, the good documents that each step of the path is the first to reject (``len(PATH)``: none is)."""
    good = labels.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull() & (F.col(quality_col) == 1))
    values = rule_values()
    step = F.least(*[F.when(values[rule] >= cutoff, F.lit(i)).otherwise(F.lit(len(PATH))) for i, (rule, cutoff) in enumerate(PATH)])
    rows = measured.where(~base_failed()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("_s"), step.alias("_k")).join(good, "_id")
    found: dict[str, dict[int, int]] = {}
    for row in rows.groupBy("_s", "_k").agg(F.count("*").alias("n")).collect():
        found.setdefault(row["_s"], {})[row["_k"]] = row["n"]
    return found


def certify_path(counts: dict[str, dict[int, int]], risk: float = 0.02, delta: float = 0.05) -> dict[tuple[str, str], float]:
    """The cutoffs by (stratum, rule) at the last step before the first whose rejections by any rule are not certified."""
    found = {}
    for stratum, first in counts.items():
        n, bad = sum(first.values()), 0
        for i, (rule, cutoff) in enumerate(PATH):
            bad += first.get(i, 0)
            if bad > risk * n or upper_bound(bad, n, delta / len(counts)) > risk:
                break
            found[(stratum, rule)] = cutoff
    return found


def certified(measured: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> dict[tuple[str, str], float]:
    """Cutoffs rule by rule and, for strata where that certifies none, of the whole rule set along the path."""
    found = certify(holdout_counts(measured, labels), risk, delta / 2)
    own = {stratum for stratum, _ in found}
    return found | {k: c for k, c in certify_path(path_counts(measured, labels), risk, delta / 2).items() if k[0] not in own}


def apply_cutoffs(measured: DataFrame, cutoffs: dict[tuple[str, str], float], *, stratum_col: str = "lang") -> DataFrame:
    """All rows with ``base_failed``, ``failed_rule`` (the first rule that rejects, or null) and ``kept``."""
    values = rule_values()
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))
    failed = F.lit(None).cast("string")
    for (name, rule), cutoff in sorted(cutoffs.items(), reverse=True):
        failed = F.when((stratum == name) & (values[rule] >= cutoff), F.lit(rule)).otherwise(failed)
    out = measured.withColumn("base_failed", base_failed()).withColumn("failed_rule", failed)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


def op4_quality_rules(spark, sf_dir):
    """Contract query: base measures of every document and the verdict of the certified cutoffs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    measured = materialise(base_measures(documents(spark, sf_dir).select("doc_id", "text", "lang")).drop("text"), "quality")
    cutoffs = certified(measured, labels)
    out = apply_cutoffs(measured, cutoffs)
    return out.select("doc_id", *[n for n, _ in BASE], "base_failed", "kept", "failed_rule")
