"""Every stage of the pipeline against a brute-force version, and the whole over odd tables."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import langid, pii
from tests.llm.test_corpus_operators import _by_id, _check_packing, _texts, stored  # noqa: F401


def _grams(text):
    text = "".join(c if c.isalpha() else "_" for c in (text or "").lower())
    if not any(c.isalpha() for c in text):
        return None
    s = "_" + "_".join(filter(None, text.split("_"))) + "_"
    if (text or "")[:1] == "":
        return None
    return collections.Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n] != "_")


def _order(counts, size=300):
    def code(g):
        return sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))

    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def test_language_stage(spark, stored):  # noqa: F811
    rng = random.Random(6)
    kinds = [["the", "thing", "with", "of", "and"], ["être", "deux", "que", "ça", "où"]]
    texts = [" ".join(rng.choice(kinds[k % 2]) for _ in range(40)) for k in range(40)] + [None, "", "123 !!", "Über 日本"]
    docs = stored(texts).withColumn("lang", F.when(F.col("doc_id") < 30, F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr")))
    profiles = {}
    for r in docs.where("lang is not null").collect():
        profiles.setdefault(r["lang"], collections.Counter()).update(_grams(r["text"]))
    ranked = {name: _order(counts) for name, counts in profiles.items()}
    want = {}
    for r in docs.collect():
        own = _grams(r["text"])
        if own is None:
            continue
        own = _order(own)
        apart = {name: sum(abs(k - p.index(g)) if g in p else 300 for k, g in enumerate(own)) for name, p in ranked.items()}
        want[r["doc_id"]] = (r["lang"] or min(sorted(apart), key=apart.get),)
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and _by_id(kept, "lang") == want


def test_repeats_stage(spark, stored):  # noqa: F811
    """Passages of 51 to 70 words in many documents, whole copies, and documents that are one sentence again and again."""
    rng = random.Random(3)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))

    passages = [words(n) for n in range(51, 71)]
    texts = [f"{words(30)} {passages[k % 20]} {words(30)}" for k in range(60)] + [words(20)] * 2 + ["One sentence again. " * 40, "One sentence again. " * 30, passages[0], None, "", " \n", "é" * 200, "é" * 190]
    docs = stored(texts)
    placed = [(r["doc_id"], r["text"]) for r in docs.collect()]
    had, want = set(), {}
    for i, text in placed:
        body = (text or "").encode()
        gone = np.zeros(len(body), dtype=bool)
        for s in range(len(body) - 180 + 1):
            if body[s : s + 180] in had:
                gone[s : s + 180] = True
            had.add(body[s : s + 180])
        left = bytes(np.frombuffer(body, np.uint8)[~gone]).decode("utf-8", "ignore")
        if left.strip() or not (text or "").strip():
            want[i] = (None, None) if text is None else (left, len(left))
    out = corpus_pipeline.repeats(spark, docs, "")
    got = _by_id(out, "text", "n_chars")
    assert out.columns == docs.columns and got == want
    kept = collections.Counter(p for t, _ in got.values() if t for p in passages if p in t)
    assert kept == collections.Counter(passages)


def test_personal_data_stage(spark, stored):  # noqa: F811
    texts = [None, "", "mail a.b@c.de or call +1 (848) 555-1373", "no data here at all", "10.0.0.1 and 4111 1111 1111 1111, 10.0.0.1"] + [f"plain text {k} " * 9 for k in range(9)]
    docs = stored(texts)
    found = _by_id(pii.find(docs, pii.fit_tagger(docs)), "spans")
    got = _by_id(corpus_pipeline.personal_data(spark, docs, ""), "text", "n_chars")
    for k, text in enumerate(texts):
        kept, at = "", 0
        for span in filter(None, found[k][0].split(",")):
            kind, low, high = span.split(":")
            if int(low) >= at:
                kept += text[at : int(low)] + f"[{kind.upper()}]"
            at = max(at, int(high))
        whole = None if text is None else kept + text[at:]
        assert got[k] == (whole, None if whole is None else len(whole))
    assert got[2][0] == "mail [EMAIL] or call [PHONE]"


def test_packing_stage(spark, stored):  # noqa: F811
    docs = stored(_texts(11, 30))
    _check_packing(corpus_pipeline.pack(spark, docs, ""), docs)


@pytest.mark.parametrize("rows", [0, 45])
def test_whole_pipeline(spark, stored, tmp_path, rows):  # noqa: F811
    """Null and repeated ids, null texts, copies and clashing columns, and an empty table."""
    texts = _texts(8, rows)[:rows] if rows else []
    ids = [None if k % 11 == 5 else k // 2 for k in range(len(texts))]
    clashing = stored(texts, ids).withColumns({"set": F.lit("a"), "_lang": F.lit("b"), "place": F.lit(1), "was_blank": F.lit("c"), "z": F.lit("d"), "root": F.lit(2.5), "row": F.lit("e"), "void": F.lit("f")})
    clashing.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == clashing.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, out.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(repr, corpus_pipeline.pack(spark, docs, "").select("doc_id", "piece", "ids_crc32").collect()))
    assert (out.count() > 0) == bool(rows)


def test_rejected_documents_have_no_letter(spark, stored):  # noqa: F811
    docs = stored(["a", "1", "日", " ", None])
    kept = corpus_pipeline.language(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2] and langid.UNKNOWN not in {r["lang"] for r in kept.collect()}
