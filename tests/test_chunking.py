"""Folds on hand-checked inputs and by their invariants."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.config import EngineConfig
from spanforge.operators import chunking as C

SMALL = EngineConfig(parent_max=40, parent_min=10, child_max=12, child_min=3)


def test_sections_and_fences():
    parts = C.cut_sections("lead\n# A\ntext\n```\n# no heading\n```\n## B\nmore\n# C\n## D\nend")
    assert [(p.chapter, p.section, p.heading_path) for p in parts] == [("", "", ""), ("A", "", "A"), ("A", "B", "A > B"), ("C", "", "C"), ("C", "D", "C > D")]
    assert "# no heading" in parts[1].text


def test_unclosed_fence_is_prose():
    assert C.blocks("a\n\nb\n```\nx\n\ny") == ["a", "b", "```\nx", "y"]
    assert C.blocks("a\n```\nx\n\ny\n```\nb") == ["a", "```\nx\n\ny\n```", "b"]


def test_merging_starts_on_a_small_section_only():
    def part(words, chapter, section):
        return C.Part(" ".join(["w"] * words), chapter, section, f"{chapter} > {section}")

    merged = C.merge_small([part(5, "A", "1"), part(20, "A", "2"), part(30, "A", "3"), part(4, "B", "4"), part(12, "B", "5")], C.count_words, SMALL)
    assert [(C.count_words(p.text), p.section) for p in merged] == [(25, "2"), (30, "3"), (16, "5")]


def test_oversized_sections_are_split():
    text = "## S\n" + "\n\n".join(" ".join(["w"] * 15) for _ in range(6))
    parts = C.split_large(C.Part(text, "A", "S", "A > S"), C.count_words, SMALL)
    assert [p.heading_path for p in parts] == ["A > S (part 1)", "A > S (part 2)", "A > S (part 3)"]
    sub = C.split_large(C.Part("## S\n" + "w " * 30 + "\n### T\n" + "w " * 30, "A", "S", "A > S"), C.count_words, SMALL)
    assert [p.heading_path for p in sub] == ["A > S", "A > S > T"]


def test_hard_split_of_prose_and_code():
    prose = C.hard_split("One two three. " + "w " * 30 + "end. Last one.", C.count_words, 12)
    assert prose[0] == "One two three." and prose[-1] == "Last one." and all(C.count_words(p) <= 12 for p in prose)
    code = C.hard_split("```py\n" + "\n".join(["a b c"] * 9) + "\n```", C.count_words, 12)
    assert len(code) == 3 and all(p.startswith("```py\n") and p.endswith("\n```") for p in code)


def test_overlap_reads_the_changed_part():
    parts = [C.Part("First sentence that is long enough. Second sentence that is long enough.", "A"), C.Part("Only one sentence that is long enough.", "A"), C.Part("Third.", "A"), C.Part("Other.", "B")]
    out = [p.text for p in C.with_overlap(parts)]
    assert out[1].startswith("First sentence")
    assert out[2] == "Second sentence that is long enough. Only one sentence that is long enough.\n\nThird."
    assert out[3] == "Other."


def test_children_fall_back_to_the_parent():
    assert C.children_of("a b", C.count_words, SMALL) == [("a b", "prose")]
    assert C.children_of("```\na b c d\n```", C.count_words, SMALL)[0][1] == "code"


def test_spans():
    assert C.locate_span("one  two\nthree", "two three") == (5, 14)
    assert C.locate_span("abc", "x") is None and C.locate_span("abc", "b") == (1, 2)


WORDS = st.lists(st.sampled_from(["alpha", "beta.", "gamma", "# H1 x", "## H2 y", "### H3 z", "```", "\n", "\n\n"]), max_size=120)


@settings(max_examples=60, deadline=None)
@given(WORDS)
def test_invariants(pieces):
    text = "".join(p if p.startswith("\n") else ("\n" + p + "\n" if p[0] in "#`" else p + " ") for p in pieces)
    parents, children = C.chunk_markdown("b", text, config=SMALL)
    assert [p["parent_id"] for p in parents] == [f"b-p{i}" for i in range(len(parents))]
    assert len({c["child_id"] for c in children}) == len(children)
    assert {c["parent_id"] for c in children} == {p["parent_id"] for p in parents}
    words = re.findall(r"\w+", text)
    assert set(words) == set(re.findall(r"\w+", " ".join(p["text"] for p in parents)))


def test_table(spark):
    md = spark.createDataFrame([("x", "# A\n" + "w " * 60), ("y", None)], "slug string, markdown string")
    done = C.chunk_books(md, config=SMALL)
    assert C.parents_of(done).count() == len(C.chunk_markdown("x", "# A\n" + "w " * 60, config=SMALL)[0])
    assert C.children_table(done).where("book = 'y'").count() == 0
