"""SimHash fingerprints and all links within a Hamming radius, by bit-sliced comparison.

Fingerprints are compared as distinct values: copies never meet. Two fingerprints
that differ in at most ``radius`` bits agree in one of ``radius`` + 1 blocks of
bits, so each is filed once per block. A crowded file is dealt out again by blocks
of the remaining bits, up to four levels, after which so few bits are left that no file
grows with the corpus. Within a file the bit planes
of 64 members stand in one word each; the distances of a query to 64 members
are counted at once with carry-save counters, and a word is abandoned once
all 64 exceed the radius. A file gives its spanning forest, not its pairs.

Defined results: null, empty and blank texts have fingerprint zero, linked like any
other. A null id is a row of its component and never its name, unless all its ids
are null. Repeated rows and ids stay. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.common import append_columns, documents, lean, materialise
from spanforge.llm.components import connected_components

RADIUS = 2
WORDS = 3
SEED = 42
#: Members of one file above which it is dealt out by further blocks.
CROWDED = 20_000
#: Levels of files; the last is compared whatever its files hold.
LEVELS = 4
#: (query, word) comparisons that are held at once.
_TASKS = 1 << 15
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: bytes | None, width: int = WORDS) -> int:
    """The fingerprint as an unsigned integer: bit i is set if it is in over half of the shingles' hashes."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), SEED)
    return majority(np.array([digest(s, SEED) for s in map(b" ".join, zip(*[words[i:] for i in range(width)]))], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned integer."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", out: str = "fp", width: int = WORDS) -> DataFrame:
    """All rows and columns with the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda texts: [np.array([simhash(t, width) for t in texts], dtype=np.uint64).view(np.int64)]

    return append_columns(docs, text_col, [(out, T.LongType())], make, as_bytes=True)


def close_pairs(values: np.ndarray, runs: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of values of the same run that differ in at most ``radius`` bits.

    ``runs`` are the places at which runs begin, ended by the length.
    """
    sizes = np.diff(runs)
    words = (sizes + 63) // 64
    first_word = np.concatenate(([0], np.cumsum(words)))
    # vertical layout: planes[b, w] has bit b of the 64 members of word w
    lane = np.arange(len(values)) - np.repeat(runs[:-1], sizes)
    word = np.repeat(first_word[:-1], sizes) + lane // 64
    planes = np.zeros((64, first_word[-1]), dtype=np.uint64)
    shift = (lane % 64).astype(np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    for b in range(64):
        planes[b] = np.bitwise_or.reduceat(((values >> np.uint64(b)) & np.uint64(1)) << shift, starts)
    used = np.bitwise_or.reduceat(np.uint64(1) << shift, starts)
    found_i, found_j = [], []
    # a query meets the words from its own on
    todo = np.repeat(first_word[1:], sizes) - word
    ends = np.cumsum(todo)
    at = 0
    while at < len(values):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TASKS, side="right")))
        count = todo[at:upto]
        query = np.repeat(np.arange(at, upto), count)
        target = np.repeat(word[at:upto], count) + (np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count))
        levels = [np.zeros(len(query), dtype=np.uint64) for _ in range(radius.bit_length())]
        beyond = np.zeros(len(query), dtype=np.uint64)
        for b in range(64):
            carry = planes[b][target] ^ (np.uint64(0) - ((values[query] >> np.uint64(b)) & np.uint64(1)))
            for k, level in enumerate(levels):
                levels[k], carry = level ^ carry, level & carry
            beyond |= carry
            if b % 8 == 7:
                over = beyond | _above(levels, radius)
                alive = np.flatnonzero((~over & used[target]) != 0)
                query, target, beyond = query[alive], target[alive], over[alive]
                levels = [level[alive] for level in levels]
        near = ~(beyond | _above(levels, radius)) & used[target]
        for k in range(64):
            hit = np.flatnonzero((near >> np.uint64(k)) & np.uint64(1))
            if len(hit):
                # place of a member: its word's first member and the lane
                j = starts[target[hit]] + k
                i = query[hit]
                keep = i < j
                found_i.append(i[keep])
                found_j.append(j[keep])
        at = upto
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def _above(levels: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius, the counter's bits being ``levels``."""
    more = np.zeros_like(levels[0])
    equal = np.full_like(levels[0], _FULL)
    for k in reversed(range(len(levels))):
        if not radius >> k & 1:
            more |= equal & levels[k]
            equal &= ~levels[k]
        else:
            equal &= levels[k]
    return more


def forest(values: np.ndarray, runs: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, root's value) that connect what close pairs connect, run by run."""
    i, j = close_pairs(values, runs, radius)
    label = np.arange(len(values))
    while len(i):
        before = label.copy()
        np.minimum.at(label, j, label[i])
        np.minimum.at(label, i, label[j])
        label = label[label]
        if (label == before).all():
            break
    at = np.flatnonzero(label != np.arange(len(values)))
    return values[at], values[label[at]]


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    step, more = divmod(len(bits), parts)
    cuts = np.cumsum([0] + [step + (k < more) for k in range(parts)])
    return [bits[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _masks(radius: int, levels: int) -> list[list[tuple[int, ...]]]:
    """For each level the masks of agreeing bits: a mask and all that it was refined from."""
    parts = radius + 1
    now = [((), list(range(64)))]
    out = []
    for _ in range(levels):
        following = []
        for path, rest in now:
            for block in _blocks(rest, parts):
                mask = sum(1 << b for b in block)
                following.append((path + (mask,), [b for b in rest if b not in set(block)]))
        out.append([p for p, _ in following])
        now = following
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, *, fp: str = "fp", radius: int = RADIUS, crowded: int = CROWDED, levels: int = LEVELS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fps`` within ``radius`` bits.

    At the default radius and levels no file holds over 16,384 values, however many fingerprints there are: the members of a file at
    the fourth level agree in at least 50 of 64 bits.
    """
    masks = _masks(radius, levels)
    rows = fps.select(F.col(fp).alias("v")).withColumn("_at", F.explode(F.array(*[F.lit(k) for k in range(len(masks[0]))])))
    out = None
    for level in range(levels):
        mask = F.element_at(F.array(*[F.lit(_signed(_union(p))) for p in masks[level]]), F.col("_at") + 1)
        filed = rows.withColumn("_file", F.col("v").bitwiseAND(mask))
        sizes = filed.groupBy("_at", "_file").agg(F.count("*").alias("_n")).where("_n > 1")
        sized = filed.join(sizes, ["_at", "_file"])
        if level == levels - 1:
            here = sized
        else:
            sized = materialise(sized, "files")
            here = sized.where(F.col("_n") <= crowded)
            parts = radius + 1
            rows = sized.where(F.col("_n") > crowded).select("v", F.explode(F.array(*[F.col("_at") * parts + k for k in range(parts)])).alias("_at"))
        got = _compared(here, radius)
        out = got if out is None else out.unionByName(got)
        if level < levels - 1 and rows.isEmpty():
            break
    return out


def _union(path: tuple[int, ...]) -> int:
    whole = 0
    for mask in path:
        whole |= mask
    return whole


def _compared(filed: DataFrame, radius: int) -> DataFrame:
    """The forests of all files; a file's rows are read in order, many files at once."""

    def run(batches):
        held: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        count = 0

        def flush(last: bool):
            nonlocal held, keys, count
            values, key = np.concatenate(held), np.concatenate(keys)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            upto = len(values) if last else (int(cuts[-1]) if len(cuts) else 0)
            if upto:
                runs = np.concatenate(([0], cuts[cuts < upto], [upto]))
                a, b = forest(values[:upto].view(np.uint64), runs, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
            held, keys, count = [values[upto:]], [key[upto:]], len(values) - upto

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            keys.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2)], axis=1))
            count += batch.num_rows
            if count >= 50_000:
                yield from flush(False)
        if count:
            yield from flush(True)

    return filed.select("v", "_at", "_file").repartition("_at", "_file").sortWithinPartitions("_at", "_file", "v").mapInArrow(lean(run), "a long, b long")


def near_duplicates(fps: DataFrame, *, id_col: str = "doc_id", fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """All rows of a stored table of fingerprints with ``component_id``, the smallest id reachable over links, and ``root``, its component's own mark (ids may repeat)."""
    classes = fps.groupBy(fp).agg(F.min(id_col).alias("_first"))
    roots = connected_components(links(classes, fp=fp, radius=radius))
    named = classes.join(roots, classes[fp] == roots["node"], "left").select(F.col(fp).alias("_v"), F.coalesce("root", F.col(fp)).alias("_root"), "_first")
    names = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    whole = materialise(named.join(names, "_root").select("_v", "component_id", F.col("_root").alias("root")), "components")
    return fps.join(whole, fps[fp] == whole["_v"]).drop("_v")


def op6_simhash_near_dedup(spark, sf_dir):
    """Contract query: each document's fingerprint and component."""
    fps = materialise(fingerprints(documents(spark, sf_dir).select("doc_id", "text")).drop("text"), "fingerprints")
    out = near_duplicates(fps)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
