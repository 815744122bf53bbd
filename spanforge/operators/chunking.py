"""Parent and child chunks of markdown books.

The folds (merging small sections, splitting large ones, overlap, greedy packing) depend on what
they have built so far, so a book is folded by one Python function; books are rows, and
rows are mapped in Arrow batches without a shuffle.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.config import EngineConfig

TokenCounter = Callable[[str], int]

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_HEADING = re.compile(r"(#{1,3})\s+(.+)")


def count_words(text: str) -> int:
    """The default token counter: white-space words."""
    return len(text.split())


def is_fence(line: str) -> bool:
    return line.lstrip().startswith("```")


@dataclass(frozen=True)
class Part:
    text: str
    chapter: str = ""
    section: str = ""
    heading_path: str = ""


def headings(lines: list[str], levels: Iterable[int]) -> Iterator[tuple[int, int, str]]:
    """(line number, level, title) of the headings outside fences."""
    inside = False
    for at, line in enumerate(lines):
        if is_fence(line):
            inside = not inside
        elif not inside and (found := _HEADING.match(line)) and len(found[1]) in levels:
            yield at, len(found[1]), found[2].strip()


def _pieces(lines: list[str], starts: list[int]) -> list[str]:
    """The stripped text from each start to the next."""
    return ["\n".join(lines[a:b]).strip() for a, b in itertools.pairwise([*starts, len(lines)])]


def cut_sections(markdown: str) -> list[Part]:
    """Sections by headings of levels 1 and 2; text before the first has no chapter."""
    lines = markdown.split("\n")
    found = list(headings(lines, (1, 2)))
    out = [Part(_pieces(lines, [0, *[at for at, _, _ in found]])[0])]
    chapter = section = ""
    for (_, level, title), text in zip(found, _pieces(lines, [at for at, _, _ in found]) if found else []):
        chapter, section = (title, "") if level == 1 else (chapter, title)
        out.append(Part(text, chapter, section, " > ".join(p for p in (chapter, section) if p)))
    return [p for p in out if p.text]


def merge_small(parts: list[Part], count: TokenCounter, config: EngineConfig) -> list[Part]:
    """A section under the minimum takes in those that follow in its chapter while the sum of counts fits."""
    out: list[Part] = []
    grows = False
    for part in parts:
        size = count(part.text)
        if grows and out[-1].chapter == part.chapter and count(out[-1].text) + size <= config.parent_max:
            last = replace(out[-1], text=f"{out[-1].text}\n\n{part.text}")
            out[-1] = replace(last, section=part.section, heading_path=part.heading_path) if part.section else last
        else:
            out.append(part)
            grows = size < config.parent_min
    return out


def greedy(units: Iterable[str], weigh: TokenCounter, limit: int) -> Iterator[list[str]]:
    """Units in order, packed while their weights fit; a unit above the limit stands alone or last."""
    held: list[str] = []
    total = 0
    for unit in units:
        weight = weigh(unit)
        if held and total + weight > limit:
            yield held
            held, total = [], 0
        held.append(unit)
        total += weight
    if held:
        yield held


def blocks(text: str) -> list[str]:
    """Fenced blocks as they are, prose as paragraphs; a fence that is never closed is prose."""
    lines = text.split("\n")
    fences = [i for i, line in enumerate(lines) if is_fence(line)]
    closed = list(zip(fences[::2], fences[1::2]))
    out, at = [], 0

    def prose(a: int, b: int) -> list[str]:
        return [p for p in "\n".join(lines[a:b]).strip().split("\n\n") if p.strip()]

    for first, last in closed:
        out += prose(at, first)
        out.append("\n".join(lines[first : last + 1]))
        at = last + 1
    if len(fences) % 2:
        out += prose(at, fences[-1])
        at = fences[-1]
    return out + prose(at, len(lines))


def split_large(part: Part, count: TokenCounter, config: EngineConfig) -> list[Part]:
    """A section above the maximum is cut at headings of level 3, and what is still too large at paragraphs."""
    if count(part.text) <= config.parent_max:
        return [part]
    lines = part.text.split("\n")
    found = [(0, "")] + [(at, title) for at, _, title in headings(lines, (3,))]
    if len(found) > 1 and found[1][0] == 0:
        found = found[1:]
    out: list[Part] = []
    for (_, title), text in zip(found, _pieces(lines, [at for at, _ in found])):
        if not text:
            continue
        path = f"{part.heading_path} > {title}" if title else part.heading_path
        if count(text) <= config.parent_max:
            out.append(replace(part, text=text, heading_path=path))
        else:
            packed = greedy(blocks(text), count, config.parent_max)
            out += [replace(part, text="\n\n".join(p), heading_path=f"{path} (part {i})") for i, p in enumerate(packed, 1)]
    return out or [part]


def hard_split(block: str, count: TokenCounter, limit: int) -> list[str]:
    """Pieces of one block above the limit: code by lines within its own fence, prose by sentences and, within a monster sentence, by words."""

    def weigh(unit: str) -> int:
        return count(unit) or 1

    if is_fence(block):
        fence, *body = block.split("\n")
        if body and is_fence(body[-1]):
            body.pop()
        return ["\n".join([fence, *held, "```"]) for held in greedy(body, weigh, limit)] or [block]
    out = []
    for (monster, _), run in itertools.groupby(enumerate(_SENTENCE_END.split(block)), lambda s: (weigh(s[1]) > limit, s[0] if weigh(s[1]) > limit else -1)):
        units = [s for _, s in run]
        out += [" ".join(held) for held in greedy(units[0].split() if monster else units, weigh, limit)]
    return out or [block]


def children_of(text: str, count: TokenCounter, config: EngineConfig) -> list[tuple[str, str]]:
    """(text, type) of a parent's children; those under the minimum are dropped unless none would be left."""
    units = itertools.chain.from_iterable([b] if count(b) <= config.child_max else hard_split(b, count, config.child_max) for b in blocks(text))
    packed = ["\n\n".join(held).strip() for held in greedy(units, count, config.child_max)]
    kept = [(p, "code" if is_fence(p) else "prose") for p in packed if count(p) >= config.child_min]
    return kept or ([(text.strip(), "prose")] if text.strip() else [])


def tail_sentences(text: str, n: int = 2, longer_than: int = 20) -> str:
    inside, prose = False, []
    for line in text.split("\n"):
        if is_fence(line):
            inside = not inside
        elif not inside:
            prose.append(line)
    return " ".join([s for s in _SENTENCE_END.split(" ".join(prose).strip()) if len(s) > longer_than][-n:])


def with_overlap(parts: list[Part]) -> list[Part]:
    """Each part of a named chapter begins with the last sentences of the part before, as it stands with its own overlap."""
    out: list[Part] = []
    for part in parts:
        lead = tail_sentences(out[-1].text) if out and part.chapter and out[-1].chapter == part.chapter else ""
        out.append(replace(part, text=f"{lead}\n\n{part.text}") if lead else part)
    return out


def chunk_markdown(slug: str, markdown: str, title: str | None = None, count: TokenCounter = count_words, config: EngineConfig = EngineConfig()) -> tuple[list[dict], list[dict]]:
    """Parents and children of one book, in order."""
    parts = itertools.chain.from_iterable(split_large(p, count, config) for p in merge_small(cut_sections(markdown), count, config))
    parents, children, number, before = [], [], 0, ""
    for n, part in enumerate(with_overlap(list(parts))):
        number += bool(part.chapter) and part.chapter != before
        before = part.chapter
        about = {"book": slug, "book_title": title or slug, "chapter": str(number), "chapter_title": part.chapter, "section": part.section, "heading_path": part.heading_path}
        parents.append({"parent_id": f"{slug}-p{n}", "ord": n, "text": part.text, **about})
        for m, (text, kind) in enumerate(children_of(part.text, count, config)):
            children.append({"child_id": f"{slug}-p{n}-c{m}", "parent_id": f"{slug}-p{n}", "ord": m, "text": text, "context_text": "", "chunk_type": kind, **about})
    return parents, children


_ABOUT = ["book", "book_title", "chapter", "chapter_title", "section", "heading_path"]
_PARENT = ["parent_id", "ord", "text", *_ABOUT]
_CHILD = ["child_id", "parent_id", "ord", "text", "context_text", "chunk_type", *_ABOUT]


def _ddl(names: list[str]) -> str:
    return ", ".join(f"{n} {'int' if n == 'ord' else 'string'}" for n in names)


def _arrow(names: list[str]) -> pa.DataType:
    return pa.list_(pa.struct([(n, pa.int32() if n == "ord" else pa.string()) for n in names]))


def chunk_books(md: DataFrame, *, count: TokenCounter = count_words, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(slug, parents, children) of books (slug, markdown and, if there, title)."""
    title = F.col("title") if "title" in md.columns else F.col("slug")

    def run(batches):
        for batch in batches:
            found = [chunk_markdown(s, m or "", t, count, config) for s, m, t in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], _arrow(_PARENT)), pa.array([c for _, c in found], _arrow(_CHILD))], names=["slug", "parents", "children"])

    return md.select("slug", "markdown", title).mapInArrow(run, f"slug string, parents array<struct<{_ddl(_PARENT).replace(' ', ':').replace(',:', ',')}>>, children array<struct<{_ddl(_CHILD).replace(' ', ':').replace(',:', ',')}>>")


def parents_of(chunked: DataFrame) -> DataFrame:
    return chunked.select(F.explode("parents").alias("p")).select("p.*")


def children_table(chunked: DataFrame) -> DataFrame:
    return chunked.select(F.explode("children").alias("c")).select("c.*")


def locate_span(parent: str, child: str) -> tuple[int, int] | None:
    """Where a child stands in its parent: as it is, or else up to white space."""
    at = parent.find(child)
    if at >= 0:
        return at, at + len(child)
    found = re.search(r"\s+".join(map(re.escape, child.split())), parent) if child.split() else None
    return found.span() if found else None


def as_dicts(parts: list[Part]) -> list[dict]:
    return [asdict(p) for p in parts]
