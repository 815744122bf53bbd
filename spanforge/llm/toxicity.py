"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of labelled documents, read whole. A text's terms are
its words and word beginnings (5 to 7 letters). Every term that tells the labels apart beyond
chance, either way (chi-squared over the sample), is in the vocabulary, whatever
their number; all words without such a term count together as one common term, so a
vector says how dense the telling words are. Weights are TF-IDF: one plus the
logarithm of the count (for the common term half the square root) times the inverse document
frequency over the examples, at unit length.

The inverted index is in blocks of examples with the largest weight of each term
in each block: a query's bound for a block is one product of sums, blocks are opened
from the highest bound on, and the search ends, exactly, when no bound reaches
the least similarity that still counts; where many blocks remain after the first few, their postings are added up at once. All examples at least as similar as the
k-th vote, with the squared cosine times the inverse of their label's sampling
rate. The votes of the examples themselves, each without itself, calibrate the
score: a logistic curve over the vote's log-odds, fitted by weighted likelihood. The examples
that voted are the evidence.

Defined results: a text without any word (null and empty ones among them) gets the weighted
toxic share of the examples. Without examples, or with one label only, scores are that
label's share (0 without any); with fewer than ``LEAST`` examples of a label votes are not
calibrated. Labels with a null id or null mark are ignored; of repeated labels the highest counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.common import append_columns, documents, fold, lean, materialise, slices, smallest_hashes

#: Most examples of each label.
EXAMPLES = 3000
NEIGHBOURS = 8
BLOCK = 64
#: Blocks that a search opens one by one before it looks at what is left.
OPENED = 4
BEGINNINGS = (5, 6, 7)
THRESHOLD = 0.7
#: Least chi-squared of a term (one degree of freedom).
SIGNIFICANT = 15.0
#: Least examples of each label for a calibration.
LEAST = 20
#: Weight of the overall share in every vote.
_PRIOR = 0.1
#: Votes stay this far from 0 and 1 before their log-odds are taken.
_EDGE = 1e-4

_words = re.compile(r"\w+").findall


def stems(word: str) -> list[str]:
    """The word itself (with its end) and its beginnings."""
    return [word + "$"] + [word[:n] for n in BEGINNINGS if len(word) >= n]


def stem_counts(text: str | None) -> Counter:
    """How often each stem occurs in a text."""
    counts: Counter = Counter()
    for word, n in Counter(_words(text.lower()) if text else []).items():
        for stem in stems(word):
            counts[stem] += n
    return counts


class Vocabulary(dict):
    """Word to the numbers of its known stems, filled on first use."""

    def __init__(self, names: list[str], limit: int = 400_000):
        super().__init__()
        self.number = {t: i for i, t in enumerate(names)}
        self.limit = limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = tuple(self.number[s] for s in stems(word) if s in self.number)
        return found

    def __reduce__(self):
        return Vocabulary, (list(self.number), self.limit)

    def counts(self, text: str | None) -> tuple[list[int], list[int], int]:
        """Known terms in order, their counts, and the number of words without any."""
        counts: Counter = Counter()
        rest = 0
        for found in map(self.__getitem__, _words(text.lower()) if text else ()):
            if found:
                counts.update(found)
            else:
                rest += 1
        terms = sorted(counts)
        return terms, [counts[t] for t in terms], rest


class Index:
    """Block-max inverted index over example vectors of unit length.

    ``examples`` are (terms, counts, rest) as ``Vocabulary.counts`` gives them.
    """

    def __init__(self, names: list[str], examples: list[tuple[list[int], list[int], int]], labels: list[int], weights: tuple[float, float], ids: list | None = None, id_type: T.DataType | None = None):
        self.vocabulary = Vocabulary(names)
        self.ids = list(range(len(examples))) if ids is None else ids
        self.id_type = id_type or T.LongType()
        n, self.size = len(examples), len(names) + 1
        self.n = n
        self.labels = np.array(labels, dtype=np.int64)
        self.votes = np.array(weights, dtype=np.float64)[self.labels] if n else np.empty(0)
        frequency = np.zeros(self.size)
        for terms, _, rest in examples:
            frequency[terms] += 1
            frequency[-1] += rest > 0
        self.idf = np.log((1 + n) / (1 + frequency)) + 1
        vectors = [self.vector(*e) for e in examples]
        self.blocks = -(-n // BLOCK)
        self.peak = np.zeros((self.size, self.blocks))
        self.lists = []
        for b in range(self.blocks):
            part = vectors[b * BLOCK : (b + 1) * BLOCK]
            term = np.concatenate([t for t, _ in part])
            weight = np.concatenate([w for _, w in part])
            member = np.repeat(np.arange(len(part)), [len(t) for t, _ in part])
            np.maximum.at(self.peak[:, b], term, weight)
            # the block's postings, one term after the other
            order = np.argsort(term, kind="stable")
            self.lists.append((term[order], member[order], weight[order]))
        # and all postings by term, for queries that few blocks can be left out of
        term = np.concatenate([t for t, _ in vectors]) if n else np.empty(0, dtype=np.int64)
        order = np.argsort(term, kind="stable")
        self.starts = np.searchsorted(term[order], np.arange(self.size + 1))
        self.member = np.repeat(np.arange(n), [len(t) for t, _ in vectors])[order]
        self.weight = np.concatenate([w for _, w in vectors])[order] if n else np.empty(0)
        every = self.votes.sum()
        self.share = float((self.votes * self.labels).sum() / every) if n else 0.0
        self.plain: tuple[float, list[int]] | None = None
        self.curve = (1.0, 0.0)
        sides = np.bincount(self.labels, minlength=2) if n else (0, 0)
        if min(sides[0], sides[1]) >= LEAST:
            left = np.array([self._vote(v, skip=i)[0] for i, v in enumerate(vectors)])
            self.curve = logistic(left, self.labels, self.votes)

    def vector(self, terms: list[int], counts: list[int], rest: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of unit length; the last term stands for the words without any."""
        at = np.array([*terms, self.size - 1] if rest else terms, dtype=np.int64)
        weight = np.array([1 + math.log(c) for c in counts] + ([math.sqrt(rest) / 2] if rest else []))
        weight = weight * self.idf[at]
        return at, weight / np.sqrt((weight**2).sum()) if len(at) else weight

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of all that are at least as similar as the k-th and share a term; without example ``skip``."""
        none = np.empty(0, dtype=np.int64), np.empty(0)
        if not len(at) or not self.n:
            return none
        bounds = weight @ self.peak[at]
        order = np.argsort(-bounds, kind="stable")
        query = np.zeros(self.size)
        query[at] = weight
        who, how, least = [], [], 0.0
        for opened, b in enumerate(order.tolist()):
            if bounds[b] <= 0 or bounds[b] < least - 1e-12:
                break
            if opened == OPENED and len(left := order[opened:][bounds[order[opened:]] >= max(least - 1e-12, 1e-300)]) > OPENED:
                # many blocks may still count: their postings are added up term by term at once
                score = np.round(self._sums(at, weight), 12)
                score[np.flatnonzero(~np.isin(np.arange(self.n) // BLOCK, left))] = 0
                if skip >= 0:
                    score[skip] = 0
                hit = np.flatnonzero(score > 0 if not least else score >= least)
                who.append(hit)
                how.append(score[hit])
                break
            term, member, held = self.lists[b]
            score = np.round(np.bincount(member, query[term] * held, BLOCK), 12)
            if skip >= 0 and skip // BLOCK == b:
                score[skip % BLOCK] = 0
            hit = np.flatnonzero(score > 0 if not least else score >= least)
            if not len(hit):
                continue
            who.append(hit + b * BLOCK)
            how.append(score[hit])
            every = np.concatenate(how)
            if len(every) >= k:
                least = float(np.partition(every, len(every) - k)[len(every) - k])
        if not who:
            return none
        who_, how_ = np.concatenate(who), np.concatenate(how)
        if len(how_) >= k:
            least = float(np.partition(how_, len(how_) - k)[len(how_) - k])
        keep = how_ >= least
        order = np.lexsort((who_[keep], -how_[keep]))
        return who_[keep][order], how_[keep][order]

    def _sums(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Products of the query with all examples."""
        parts = [slice(self.starts[t], self.starts[t + 1]) for t in at.tolist()]
        held = np.concatenate([self.weight[p] * w for p, w in zip(parts, weight.tolist())])
        return np.bincount(np.concatenate([self.member[p] for p in parts]), held, self.n)

    def _vote(self, vector: tuple[np.ndarray, np.ndarray], skip: int = -1) -> tuple[float, np.ndarray]:
        who, cosine = self.nearest(*vector, skip=skip)
        vote = self.votes[who] * cosine**2
        return float(((vote * self.labels[who]).sum() + _PRIOR * self.share) / (vote.sum() + _PRIOR)), who

    def score(self, text: str | None) -> tuple[float, list]:
        """Score and the first examples of evidence of a text."""
        terms, counts, rest = self.vocabulary.counts(text)
        if not self.n or not (terms or rest):
            return self.share, []
        if not terms:
            if self.plain is None:
                self.plain = self._scored(self.vector(terms, counts, 1))
            return self.plain
        return self._scored(self.vector(terms, counts, rest))

    def _scored(self, vector) -> tuple[float, list]:
        vote, who = self._vote(vector)
        return calibrated(vote, self.curve), [self.ids[i] for i in who[:5].tolist()]


def calibrated(vote: float, curve: tuple[float, float]) -> float:
    if curve == (1.0, 0.0):
        return vote
    vote = min(max(vote, _EDGE), 1 - _EDGE)
    return 1 / (1 + math.exp(-(curve[0] * math.log(vote / (1 - vote)) + curve[1])))


def logistic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve over the votes' log-odds; no change where none with a rising slope is found."""
    x = np.clip(votes, _EDGE, 1 - _EDGE)
    x = np.log(x / (1 - x))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        miss, bend = weights * (p - labels), weights * p * (1 - p) + 1e-9
        # a slight pull to the slope 1 keeps the curve finite where the votes part the labels
        slope = np.array([(miss * x).sum() + 0.01 * (a - 1), miss.sum() + 0.01 * b])
        curve = np.array([[(bend * x * x).sum() + 0.01, (bend * x).sum()], [(bend * x).sum(), bend.sum() + 0.01]])
        step = np.clip(np.linalg.solve(curve, slope), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-10:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit_index(docs: DataFrame, labels: DataFrame, train=None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> Index:
    """The index over at most ``examples`` labelled documents of each label (smallest hashes of the id).

    ``train`` is a boolean column over ``id_col``. Terms are counted by the executors; the driver gets
    the vocabulary and the examples' counts, both bounded by the sample.
    """
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"), (F.lit(True) if train is None else train).alias("u")).where("u and i is not null and y in (0, 1)")
    marks = materialise(marks.groupBy("i").agg(F.max("y").alias("y")), "marks")
    all_ = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = smallest_hashes(marks, "y", "i", examples).select("i", "y")
    # at most 2 * examples rows are broadcast
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    sample = materialise(texts.join(F.broadcast(chosen), "i"), "examples")

    def count(batches):
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for whole in batches:
            for batch in slices(whole):
                for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    held[y].update(stem_counts(text).keys())
        names = list(held[0].keys() | held[1].keys())
        for a in range(0, len(names), 100_000):
            part = names[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[0][t] for t in part], pa.int64()), pa.array([held[1][t] for t in part], pa.int64())], names=["term", "n0", "n1"])

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    counts = sample.select("t", "y").mapInArrow(lean(count), "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").cast("double").alias("a"), F.sum("n1").cast("double").alias("b")).where("a + b >= 4")
    a, b = F.col("a"), F.col("b")
    tilt = b * n0 - a * n1
    chi = (n0 + n1) * tilt * tilt / F.greatest((a + b) * (n0 + n1 - a - b) * F.lit(float(n0) * n1), F.lit(1.0))
    names = sorted(r["term"] for r in counts.where(chi >= SIGNIFICANT).select("term").collect())
    known = Vocabulary(names)

    def vectors(batches):
        for whole in batches:
            for batch in slices(whole):
                found = [known.counts(text) for text in batch.column(1).to_pylist()]
                cols = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=["i", "y", "v", "c", "r"])

    many = T.ArrayType(T.IntegerType())
    schema = T.StructType([sample.schema["i"], T.StructField("y", T.IntegerType()), T.StructField("v", many), T.StructField("c", many), T.StructField("r", T.LongType())])
    rows = sample.select("i", "t", "y").mapInArrow(lean(vectors), schema).collect()
    # examples of like terms share a block
    rows.sort(key=lambda r: (r["v"], r["y"], r["c"], r["r"], r["i"]))
    weights = tuple(all_.get(y, 0) / max(1, sizes.get(y, 0)) for y in (0, 1))
    scale = sum(weights) / 2 or 1
    return Index(names, [(r["v"], r["c"], r["r"]) for r in rows], [r["y"] for r in rows], (weights[0] / scale, weights[1] / scale), [r["i"] for r in rows], sample.schema["i"].dataType)


def score_texts(docs: DataFrame, index: Index, *, text_col: str = "text", score_out: str = "score", evidence_out: str | None = "evidence") -> DataFrame:
    """All rows and columns with the score and the ids of the nearest examples (at most five)."""
    fields = [(score_out, T.DoubleType())] + ([(evidence_out, T.ArrayType(index.id_type))] if evidence_out else [])

    def make():
        def run(texts):
            found = [index.score(t) for t in texts]
            return [[f[0] for f in found]] + ([[f[1] for f in found]] if evidence_out else [])

        return run

    return append_columns(docs, text_col, fields, make)


def op3_toxicity(spark, sf_dir):
    """Contract query: scores of every document from examples of the folds other than 1 of 3."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    index = fit_index(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 3) != 1)
    rows = docs.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)))
    scored = score_texts(rows, index).drop("text")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
