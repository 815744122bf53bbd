"""Files to tables, the document store from end to end, and streaming ingestion."""

import io
import json
import zipfile

import pytest

from spanforge.api import DocumentStore
from spanforge.config import EngineConfig
from spanforge.sources import converters, readers, sinks
from spanforge.streaming.ingest import chunk_stream

CONFIG = EngineConfig(parent_max=60, parent_min=10, child_max=20, child_min=2)


def _epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<h1>Second</h1><p>Two words</p>")
        z.writestr("o/b.xhtml", "<h1>First</h1><p>One word</p><script>x</script>")
    return out.getvalue()


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "web").mkdir(parents=True)
    (root / "web" / "cache-notes.md").write_text("## Caches\n" + "A cache keeps results that are costly to make. " * 6 + "\n### Expiry\nEntries expire after a while and are made again.")
    (root / "page.html").write_text("<html><body><h1>Locks</h1><p>A lock guards a shared thing.</p><ul><li>one</li></ul><nav>menu</nav></body></html>")
    (root / "book.epub").write_bytes(_epub())
    (root / "paper.pdf").write_bytes(b"%PDF")
    (root / "skip.txt").write_text("no")
    return str(root)


def test_converters():
    text = converters.html_to_markdown(b"<h2>T</h2><p>a <b>b</b></p><pre>x\n y</pre><script>no</script>")
    assert text == "## T\n\na **b**\n\n```\nx\n y\n```\n"
    assert converters.epub_to_markdown(_epub()).index("First") < converters.epub_to_markdown(_epub()).index("Second")


def test_references_without_a_semicolon_are_text():
    # html_convert's SQL keeps the cut reference at the end of a title
    assert converters.html_to_markdown(b"<h1>a&amp;&amp</h1><p>&quot;b&quot; &ampx; &#38; &#38 &notit; &lt; &a & \xee\x80\x80") == "# a&&amp\n\n\"b\" &ampx; & &#38 &notit; < &a & \ue000\n"


def test_document_store(spark, folder, tmp_path):
    kb = DocumentStore(spark, str(tmp_path / "kb"), CONFIG)
    failed = [r["slug"] for r in kb.build(folder).collect()]
    assert failed == ["paper"]
    assert [(b["slug"], b["domain"]) for b in kb.list_books()] == [("book", "general"), ("cache-notes", "web"), ("page", "general")]
    best = kb.search("when do cache entries expire", 2)[0]
    assert best["book"] == "Cache Notes"
    assert kb.read_chunk(best["chunk_id"])["book"] == "cache-notes"
    assert "error" in kb.read_chunk("nope") and "error" in kb.search_book("x", "nope")[0] and "error" in kb.grep_books("(")[0]
    assert kb.grep_books("LOCK guards")[0]["book"] == "page"
    assert "Locks" in kb.get_chapter("page", "locks")
    before = kb.table("children").count()
    kb.build(folder)
    assert kb.table("children").count() == before


def test_manifest_chunk_and_label_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"books": {"a-b": {"domain": "x", "rerank_input": "odd"}}}))
    row = readers.read_manifest(spark, str(tmp_path / "m.json")).first()
    assert (row["title"], row["rerank_input"]) == ("A B", "child")
    (tmp_path / "bad.json").write_text("{oops")
    assert readers.read_manifest(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "g.jsonl").write_text('{"query": "q1", "positive_child_ids": ["a"]}\n{"query": "q2", "relevance_grades": {"p": 2}}\n')
    assert [r["query"] for r in readers.read_golden(spark, str(tmp_path / "g.jsonl"), 1).collect()] == ["q1"]
    (tmp_path / "c.json").write_text(json.dumps({"parents": [{"parent_id": "p", "text": "t"}], "children": [{"child_id": "c", "parent_id": "p", "text": "t"}]}))
    parents, children = readers.read_chunks(spark, str(tmp_path / "c.json"))
    assert parents.first()["parent_id"] == "p" and children.first()["child_id"] == "c"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.append_new(rows, path, "k")
    sinks.append_new(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), path, "k")
    assert spark.read.parquet(path).count() == 3
    old = spark.createDataFrame([("a", "mine")], "slug string, title string")
    new = spark.createDataFrame([("a", "theirs"), ("b", "b")], "slug string, title string")
    assert [tuple(r) for r in sinks.merge_manifest(new, old).collect()] == [("a", "mine"), ("b", "b")]
    sheets = spark.createDataFrame([("s", "2", "Two", "# x\n```\n# y"), ("s", "1", "One", "text")], "slug string, path string, title string, markdown string")
    assert sinks.concat_sheets(sheets).first()["markdown"] == "## One\n\ntext\n\n## Two\n\n### x\n```\n# y\n```"


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([("s", "# A\n" + "w " * 30)], "slug string, markdown string").write.parquet(src)
    for _ in range(2):
        chunk_stream(spark, src, out + "/p", out + "/c", out + "/ck", CONFIG).awaitTermination(120)
    assert spark.read.parquet(out + "/p").count() == 1


def test_config():
    assert EngineConfig.from_env({"SPANFORGE_TOP_K": "3"}).top_k == 3
    with pytest.raises(ValueError):
        EngineConfig(rerank_input="odd")


def test_repeated_keys_of_a_batch_are_appended_once(spark, tmp_path):
    from spanforge.sources import sinks

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "k string, v int")
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.append_new(rows.where("k is not null"), path, "k")
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == ["a", "b"]
    sinks.append_new(rows, path, "k")
    assert spark.read.parquet(path).where("k is null").count() == 2


def test_a_missing_manifest_is_empty(spark, tmp_path):
    from spanforge.sources import readers

    none = readers.read_manifest(spark, str(tmp_path / "none.json"))
    assert none.columns == ["slug", "title", "domain", "rerank_input"] and none.collect() == []


def test_reports_and_audit(spark, tmp_path):
    from spanforge.sources import sinks

    report = spark.createDataFrame([("all", 0.5)], "stratum string, ndcg double")
    path = str(tmp_path / "runs")
    sinks.write_report(report, path, "one")
    sinks.write_report(report, path, "two")
    sinks.write_report(report.limit(0).unionByName(report), path, "one")
    assert sorted(r["run"] for r in spark.read.json(path).collect()) == ["one", "two"]
    for _ in range(2):
        sinks.append_audit(report, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
