"""Model interfaces and deterministic stand-ins that need no files and no network."""

from __future__ import annotations

import base64
import re
import time
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str], kind: str) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


#: Generates a text from a prompt; an exception means no answer.
Generator = Callable[[str], str]

_TERM = re.compile(r"[a-z0-9]+")


class HashingEmbedder:
    """Signed feature hashing of terms, unit length; queries and passages alike."""

    def __init__(self, dim: int = 64, max_chars: int = 8000):
        self.dim, self.max_chars = dim, max_chars

    def encode(self, texts: list[str], kind: str = "passage") -> np.ndarray:
        if kind not in ("query", "passage"):
            raise ValueError(f"unknown kind {kind}")
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for term in _TERM.findall((text or "")[: self.max_chars].lower()):
                h = zlib.crc32(term.encode())
                out[i, h % self.dim] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _by_task(model, texts: list[str], kind: str):
    return model.encode(texts, task=f"retrieval.{kind}")


def _by_method(model, texts: list[str], kind: str):
    return (model.encode_query if kind == "query" else model.encode_document)(texts)


def _mean_of_tokens(model, texts: list[str], kind: str):
    """The unit mean of a text's token vectors; queries and passages alike."""
    means = np.array([np.asarray(model.token_vectors(t)).mean(axis=0) for t in texts])
    return means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)


#: How models are told queries from passages.
IDIOMS = {"task": _by_task, "method": _by_method, "mean": _mean_of_tokens}


class ModelEmbedder:
    """An embedder over a model that ``load`` gives, spoken to in one of ``IDIOMS``; each Python worker loads it once, on first use."""

    def __init__(self, load: Callable[[], object], idiom: str, dim: int, max_chars: int = 8000):
        if idiom not in IDIOMS:
            raise ValueError(f"unknown idiom {idiom}")
        self.load, self.idiom, self.dim, self.max_chars, self._model = load, idiom, dim, max_chars, None

    def __getstate__(self):
        return self.__dict__ | {"_model": None}

    def encode(self, texts: list[str], kind: str = "passage") -> np.ndarray:
        if kind not in ("query", "passage"):
            raise ValueError(f"unknown kind {kind}")
        if self._model is None:
            self._model = self.load()
        cut = [(t or "")[: self.max_chars] for t in texts]
        return np.asarray(IDIOMS[self.idiom](self._model, cut, kind)) if cut else np.zeros((0, self.dim))


class LexicalReranker:
    """Ten times the share of the query's distinct terms that a text holds."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        q = set(_TERM.findall(query.lower()))
        return [10.0 * len(q & set(_TERM.findall((t or "").lower()))) / max(1, len(q)) for t in texts]


class ModelReranker:
    """A reranker over a model that scores pairs (``predict``); each Python worker loads it once, on first use."""

    def __init__(self, load: Callable[[], object]):
        self.load, self._model = load, None

    def __getstate__(self):
        return {"load": self.load, "_model": None}

    def score(self, query: str, texts: list[str]) -> list[float]:
        if not texts:
            return []
        if self._model is None:
            self._model = self.load()
        return [float(x) for x in self._model.predict([(query, t or "") for t in texts])]


def embed_column(rows: DataFrame, text: str, embedder: Embedder, out: str = "embedding", kind: str = "passage") -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(texts):
        import pandas as pd

        return pd.Series(list(embedder.encode(texts.tolist(), kind)))

    return rows.withColumn(out, run(F.col(text)))


def rerank(hits: DataFrame, reranker: Reranker, query: str = "query", text: str = "rerank_text") -> DataFrame:
    """Hits with their scores replaced by the reranker's."""

    @F.pandas_udf("double")
    def run(queries, texts):
        import pandas as pd

        return pd.Series([round(reranker.score(q, [t])[0], 6) for q, t in zip(queries, texts)])

    return hits.withColumn("score", run(F.col(query), F.col(text)))


def enrich(chunks: DataFrame, generate: Generator, prompt: str = "prompt", fallback: str = "fallback") -> DataFrame:
    """``context_text`` of chunks that have none: the generator's answer to a prompt, else the fallback."""

    @F.pandas_udf("string")
    def run(prompts, fallbacks):
        import pandas as pd

        out = []
        for p, f in zip(prompts, fallbacks):
            try:
                out.append(generate(p))
            except Exception:
                out.append(f)
        return pd.Series(out)

    empty = F.coalesce(F.col("context_text"), F.lit("")) == ""
    return chunks.withColumn("context_text", F.when(empty, run(F.when(empty, F.col(prompt)), F.col(fallback))).otherwise(F.col("context_text")))


class BpeCounter:
    """Tokens of a text by a byte-level BPE given as ranks (lines of a base64 token and its rank) and a pattern of pre-tokens.

    Strings of special tokens are ordinary text. The ranks are read where texts are
    counted, so the file must be there on every executor.
    """

    def __init__(self, ranks: str, pattern: str):
        self.ranks, self.pattern, self._encode = ranks, pattern, None

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "_encode": None}

    def __call__(self, text: str) -> int:
        if self._encode is None:
            import tiktoken

            with open(self.ranks, "rb") as file:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            self._encode = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        return len(self._encode(text))


def fan_out(rows: DataFrame, call: Generator, prompt: str, out: str = "answer", *, workers: int = 25, attempts: int = 3, wait: float = 0.5) -> DataFrame:
    """Rows with ``out``, the answer of ``call`` to a prompt, and ``error`` (null where there is an answer).

    Each partition keeps up to ``workers`` calls under way and holds the rows of one Arrow batch;
    a call that raises is tried ``attempts`` times, the pause doubling. A null prompt is not
    asked and has neither answer nor error.
    """
    names = [c for c in rows.columns if c not in (out, "error")]
    at = names.index(prompt)

    def ask(text):
        if text is None:
            return None, None
        for attempt in range(attempts):
            try:
                return call(text), None
            except Exception as error:
                failed = f"{type(error).__name__}: {error}"
                if attempt + 1 < attempts:
                    time.sleep(wait * 2**attempt)
        return None, failed

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                found = list(pool.map(ask, batch.column(at).to_pylist()))
                answers, errors = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, answers, errors], names=[*names, out, "error"])

    kept = rows.select(*[F.col(f"`{n}`") for n in names])
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType()), T.StructField("error", T.StringType())]))
