"""Token counters, calls to services, recovery of pages, the tool server and the HTML converter's edges."""

import io
import json
import os

import pytest

from spanforge import server
from spanforge.functions import models
from spanforge.operators import chunking
from spanforge.plans import chunking_queries
from spanforge.sources import converters


def test_bpe_counter_counts_bytes_and_merges(tmp_path):
    import base64
    import pickle

    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    count = models.BpeCounter(str(path), r"\S+|\s+")
    assert count("abc ab") == 3 and count("") == 0 and count("é") == 2
    assert pickle.loads(pickle.dumps(count))("abcabc") == 2


def test_fan_out_tries_again_and_reports(spark, tmp_path):
    folder = str(tmp_path)

    def call(text):
        mark = os.path.join(folder, text)
        if text == "never":
            raise ValueError("no")
        if text == "second" and not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("busy")
        return text.upper()

    rows = spark.createDataFrame([(1, "first", "x"), (2, "second", None), (3, "never", ""), (4, None, "y")], "id int, ask string, error string")
    got = {r["id"]: (r["answer"], r["error"]) for r in models.fan_out(rows, call, "ask", wait=0.0).collect()}
    assert got == {1: ("FIRST", None), 2: ("SECOND", None), 3: (None, "ValueError: no"), 4: (None, None)}
    assert models.fan_out(rows.limit(0), call, "ask").count() == 0


def test_garbled_pages_are_read_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def read(image):
        with open(log, "a") as file:
            file.write(image + "\n")
        if image == "broken":
            raise ValueError("unreadable")
        return f"text of {image}"

    bad = "\u0531" * 5
    pages = spark.createDataFrame([(1, "clean", "a"), (2, bad, "b"), (3, bad, "broken"), (4, None, "d")], "page_id long, text string, image string")
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = {r["page_id"]: r["text"] for r in converters.recover_pages(pages, cache, read, attempts=1).collect()}
        assert got == {1: "clean", 2: "text of b", 3: bad, 4: None}
    with open(log) as file:
        assert file.read().split().count("b") == 1


def test_html_edges():
    skipped = converters.html_to_markdown(b"<head><title>t</title><body><nav><ul><li>menu</li></ul><pre>x</pre></nav><h2>A</h2><p>b <b>c</b></p>")
    assert skipped == "## A\n\nb **c**\n"
    assert converters.html_to_markdown(b"") == "\n"


class _Store:
    def search(self, query, top_k=10):
        """Find passages."""
        return [{"query": query, "top_k": top_k}]

    search_book = list_books = get_chapter = read_chunk = grep_books = search


def test_server_answers_line_by_line():
    lines = [json.dumps({"id": 1, "tool": "search", "arguments": {"query": "q"}}), "", "{", json.dumps({"id": 2, "tool": "__init__"}), json.dumps({"id": 3, "tool": "search"}), json.dumps({"id": 4, "tool": "tools"})]
    out = io.StringIO()
    server.serve(_Store(), lines, out)
    got = [json.loads(line) for line in out.getvalue().splitlines()]
    assert got[0] == {"id": 1, "result": [{"query": "q", "top_k": 10}]}
    assert [g["id"] for g in got] == [1, None, 2, 3, 4] and all("error" in g for g in got[1:4])
    assert [t["name"] for t in got[4]["result"]] == list(server.TOOLS) and got[4]["result"][0]["required"] == ["query"]


@pytest.mark.parametrize("markdown", [
    "intro\n\n# A\n" + "one two three. " * 30 + "\n\n## B\n" + "four five six seven. " * 400 + "\n\n### C\n" + "eight. " * 700 + "\n\n" + "nine ten eleven. " * 300,
    "# A\n```\n# no heading\n```\n" + "word " * 900 + "\n## B\nshort text that is long enough to count. Another one of those sentences here.\n# A\nagain\n# D\n```\nnever closed",
    "## only sections\n" + "a b c d e f. " * 260 + "\n\n\n" + "g " * 260,
])
def test_folds_against_sql(markdown):
    """Books that the tables do not hold: sections above the maximum, headings of level 3, monster sentences, open fences."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE book AS SELECT 'b' AS slug, ? AS markdown", [markdown])
    parents, children = chunking.chunk_markdown("b", markdown)
    for name, rows in (("chunk_parents", parents), ("chunk_children", children)):
        sql = chunking_queries.ORACLE[name]
        start = sql.index("md AS (SELECT")
        end = sql.index("lines AS (SELECT")
        got = con.execute(sql[:start] + "md AS (SELECT * FROM book), " + sql[end:])
        names = [d[0] for d in got.description]
        assert sorted(map(repr, got.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in rows)


class _Model:
    def encode(self, texts, task):
        return [[len(t), len(task)] for t in texts]

    def encode_query(self, texts):
        return [[1.0, 0.0] for _ in texts]

    def encode_document(self, texts):
        return [[0.0, 1.0] for _ in texts]

    def token_vectors(self, text):
        return [[3.0, 0.0], [3.0, 8.0]]


def test_idioms(spark):
    task = models.ModelEmbedder(_Model, "task", 2, max_chars=3)
    assert task.encode(["abcdef", None], "query").tolist() == [[3, 15], [0, 15]]
    method = models.ModelEmbedder(_Model, "method", 2)
    assert method.encode(["a"], "query").tolist() == [[1, 0]] and method.encode(["a"]).tolist() == [[0, 1]]
    assert models.ModelEmbedder(_Model, "mean", 2).encode(["a"]).round(6).tolist() == [[0.6, 0.8]]
    assert task.encode([]).shape == (0, 2)
    for wrong in (lambda: models.ModelEmbedder(_Model, "other", 2), lambda: task.encode(["a"], "title")):
        with pytest.raises(ValueError):
            wrong()


def test_a_failed_run_goes_on(spark, tmp_path):
    from pyspark.sql import functions as F

    from spanforge.sources import sinks

    path, calls = str(tmp_path / "t"), []

    def make(some):
        calls.append(some)
        if len(calls) == 6:
            raise RuntimeError("lost")
        return some.withColumn("v", F.col("k") * 2)

    rows = spark.range(40).withColumnRenamed("id", "k")
    with pytest.raises(RuntimeError):
        sinks.append_in_parts(rows, path, "k", make, 4)
    before = spark.read.parquet(path).count()
    assert 0 < before < 40
    sinks.append_in_parts(rows, path, "k", make, 4)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2 * k for k in range(40)]


def test_rewrite_keeps_the_first_backup(spark, tmp_path):
    from spanforge.sources import sinks

    path, backup = str(tmp_path / "t"), str(tmp_path / "b")
    spark.range(5).write.parquet(path)
    for least in (2, 4):
        sinks.rewrite_with_backup(spark.read.parquet(path).where(f"id >= {least}"), path, backup)
    assert [r["id"] for r in spark.read.parquet(path).collect()] == [4]
    assert spark.read.parquet(backup).count() == 5


def test_latency():
    from spanforge.operators import evaluation

    seen = []
    got = evaluation.latency(seen.append, ["a", "b", "c"], warm=2)
    assert seen == ["a", "b", "a", "b", "c"] and got["n"] == 3 and got["median"] <= got["p90"]
    assert evaluation.latency(seen.append, []) == {"n": 0}


def test_model_reranker_loads_once():
    import pickle

    loaded = []

    class Pairs:
        def predict(self, pairs):
            return [len(a) + len(b) for a, b in pairs]

    def load():
        loaded.append(1)
        return Pairs()

    reranker = models.ModelReranker(load)
    assert reranker.score("q", []) == [] and not loaded
    assert reranker.score("q", ["ab", None]) == [3.0, 1.0] and reranker.score("q", ["a"]) == [2.0] and len(loaded) == 1
    assert pickle.loads(pickle.dumps(models.ModelReranker(_Model)))._model is None


def test_extractors_side_by_side():
    from spanforge.operators import evaluation

    got = evaluation.extractor_table({"good": lambda c: c.decode(), "bad": lambda c: 1 / 0}, b"# A\ntext\n## B\n### C\n#### D\n#x")
    assert {k: got[0][k] for k in ("name", "h1", "h2", "h3", "first")} == {"name": "good", "h1": 1, "h2": 1, "h3": 1, "first": ["# A", "## B", "### C"]}
    assert got[1]["error"].startswith("ZeroDivisionError")


def test_capped_text_may_come_back_in_another_part(spark):
    from spanforge.operators import labeling

    rows = spark.createDataFrame([(1, "a", "X"), (2, "a", "y"), (3, "b", "Y"), (4, "b", "x"), (5, "c", "z"), (6, "b", None)], "id int, part string, query string")
    assert sorted(r["id"] for r in labeling.distinct_then_capped(rows, {"a": 1, "b": 2}, 3).collect()) == [1, 3]
    assert labeling.distinct_then_capped(rows.limit(0), {"a": 1}, 3).count() == 0
