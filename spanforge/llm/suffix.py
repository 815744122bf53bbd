"""Removal of repeated byte strings by sorting suffixes deep-shallow.

A string of ``WINDOW`` bytes repeats if it starts at two places of the corpus. Of each
such string one byte position is its anchor: the first of its 32-byte grams
with the least hash. Equal strings have their anchors at equal offsets, so only
texts that share an anchor gram can share a string, and an anchor is responsible for a
contiguous range of string starts. Anchors seen at one place only are dropped. The rest
get their context, the bytes of all strings they stand for, and the contexts of one
anchor gram meet in one task: their right parts are sorted as suffixes and
their left parts as reversed prefixes, by multikey quicksort to a shallow depth
and then, for groups with a longer common prefix, by a blind trie. From the
common prefix lengths of neighbours in both orders follow, for every number of left
bytes, the classes of equal strings.

An anchor gram at more than ``crowded`` places is not sorted in one task: its contexts are
collapsed by their hash and their single strings are dealt out by theirs.
Copies of a whole text take part once and are known to repeat.

With ``first_stays`` a string's first place (by row, then by position) is not
removed, so repeated text is kept once.

Strings of two lengths are found together by ``nested_spans``: longer ones that repeat
lie within runs of shorter ones, so only such runs are searched again.

Defined results: null is the empty text. Texts shorter than the window keep
everything. Matches never cross texts. Repeated rows repeat each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.common import documents, lean, materialise, scratch, slices

WINDOW = 400
#: Bytes of a string that counts as a repeated passage: just over 50 words are longer in nearly all cases, and often shorter than ``WINDOW``.
PASSAGE = 180
#: Words that a passage holds at least.
PASSAGE_WORDS = 51
#: Bytes of a gram, 2 to the number of odd factors below.
GRAM = 32
SHALLOW = 32
#: Places of one anchor gram above which its strings are dealt out singly.
CROWDED = 20_000
#: Bytes of text that are hashed at once.
_CHUNK = 1 << 21
#: Parts that the rows of one key are dealt into where a key may be hot.
_SALTS = 16
#: Bits of an anchor's distances to its first and last string, beside its position.
_BITS = 16

_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


# -- anchors ---------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each position on."""
    h = _TABLE[data]
    for k, odd in enumerate(_ODD):
        step = 1 << k
        h = h[:-step] * odd + h[step:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Text number, gram hash, position, first and last string start of each anchor.

    ``data`` holds texts of at least ``window`` bytes end to end, ``bounds`` where each begins and the end.
    """
    h = gram_hashes(data)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, span = window - GRAM + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    chosen = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(chosen))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(chosen)]
    inside = starts + window <= bounds[1:][text]
    chosen[~inside] = -1
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    last = np.append(first[1:], len(chosen)) - 1
    keep = chosen[first] >= 0
    first, last = first[keep], last[keep]
    at, of = chosen[first], text[first]
    begin = bounds[:-1][of]
    return of, h[at], at - begin, first - begin, last - begin


def _anchor_rows(keyed: DataFrame, window: int) -> DataFrame:
    """(h, uid, k1, span) of every text of ``keyed`` (uid, k1, body); ``span`` is the anchor's position and its distances to the first and last string start."""
    if not GRAM <= window < 1 << _BITS:
        raise ValueError(f"a window must have at least {GRAM} and under {1 << _BITS} bytes")

    def run(batches):
        held, size = [], 0

        def flush():
            data = np.frombuffer(b"".join(t for _, _, t in held), dtype=np.uint8)
            bounds = np.concatenate(([0], np.cumsum([len(t) for _, _, t in held])))
            of, h, pos, lo, hi = anchors(data, bounds, window)
            uid, key = (np.array([x[k] for x in held], dtype=np.int64) for k in (0, 1))
            span = pos << 2 * _BITS | pos - lo << _BITS | hi - lo
            cols = [h.view(np.int64), uid[of], key[of], span]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["h", "uid", "k1", "span"])

        for whole in batches:
            for batch in slices(whole):
                for uid, key, body in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                    if len(body) >= window:
                        held.append((uid, key, body))
                        size += len(body)
                        if size >= _CHUNK:
                            yield flush()
                            held, size = [], 0
        if held:
            yield flush()

    return keyed.select("uid", "k1", "body").mapInArrow(lean(run), "h long, uid long, k1 long, span long")


# -- deep-shallow sorting ----------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Places of the strings in ascending order: multikey quicksort to ``shallow`` bytes, then blind tries."""
    out: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) < 2:
            out += group
            continue
        if depth >= shallow:
            out += _blind_trie(strings, group)
            continue
        keys = [strings[i][depth : depth + 4] for i in group]
        pivot = keys[len(keys) // 2]
        less, same, more = [], [], []
        for i, key in zip(group, keys):
            (same if key == pivot else less if key < pivot else more).append(i)
        todo.append((more, depth))
        if len(pivot) < 4:
            todo.append((same, shallow))
        else:
            todo.append((same, depth + 4))
        todo.append((less, depth))
    return out


def _blind_trie(strings: list[bytes], group: list[int]) -> list[int]:
    """Order of strings that share a long prefix, by a compacted trie that is searched without comparing.

    A node is ``[depth, children]``, children by their byte at that depth (-1 where a
    string ends); a leaf is the list of equal strings' places.
    """
    root: list = [group[0]]
    for i in group[1:]:
        text = strings[i]
        node = root
        while isinstance(node[-1], dict):
            at = text[node[0]] if node[0] < len(text) else -1
            node = node[1].get(at) or next(iter(node[1].values()))
        other = strings[node[0]]
        depth = common_prefix(text, other)
        if depth == len(text) == len(other):
            node.append(i)
            continue
        parent, edge, node = None, None, root
        while isinstance(node[-1], dict) and node[0] < depth:
            edge = text[node[0]]
            parent, node = node, node[1][edge]
        own = text[depth] if depth < len(text) else -1
        if isinstance(node[-1], dict) and node[0] == depth:
            node[1][own] = [i]
            continue
        split = [depth, {own: [i], other[depth] if depth < len(other) else -1: node}]
        if parent is None:
            root = split
        else:
            parent[1][edge] = split
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node[-1], dict):
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def repeated_ranges(contexts: list[tuple[bytes, int]], counts: list[int], window: int = WINDOW, first_stays: bool = False) -> list[list[tuple[int, int]]]:
    """For each distinct context (bytes, place of the anchor) the byte ranges covered by strings that repeat.

    A context that occurs more than once repeats as a whole. With ``first_stays`` the contexts
    are in order of their first places, and only strings that an earlier context has count.
    """
    m = len(contexts)
    out: list[list[tuple[int, int]]] = [[(0, len(c))] if n > 1 and not first_stays else [] for (c, _), n in zip(contexts, counts)]
    if m < 2:
        return out
    right = [c[at:] for c, at in contexts]
    left = [c[:at][::-1] for c, at in contexts]
    if m == 2:
        r, l = common_prefix(*right), common_prefix(*left)
        if r + l >= window:
            for i, (_, at) in enumerate(contexts):
                if not out[i] and (i or not first_stays):
                    out[i] = [(at - l, at + r)]
        return out
    sides = []
    for strings in (right, left):
        order = np.array(deep_shallow_order(strings))
        shared = np.array([common_prefix(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:])])
        place = np.empty(m, dtype=np.int64)
        place[order] = np.arange(m)
        sides.append((shared, place, np.array([len(s) for s in strings])))
    (shared_r, place_r, size_r), (shared_l, place_l, size_l) = sides
    # number of left bytes at which a class or the reach of a context changes
    most = min(window, int(size_l.max()))
    turns = np.unique(np.clip(np.concatenate(([0], window - shared_r, shared_l + 1, window - size_r, size_l + 1)), 0, most + 1))
    turns = turns[turns <= most]
    ends = np.append(turns[1:], most + 1)
    step = max(1, 2_000_000 // m)
    single = [i for i in range(m) if not out[i]]
    spans: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for a in range(0, len(turns), step):
        d = turns[a : a + step, None]
        cls_r = np.concatenate((np.zeros((len(d), 1), dtype=np.int64), np.cumsum(shared_r[None, :] < window - d, axis=1)), axis=1)[:, place_r]
        cls_l = np.concatenate((np.zeros((len(d), 1), dtype=np.int64), np.cumsum(shared_l[None, :] < d, axis=1)), axis=1)[:, place_l]
        key = cls_r * m + cls_l
        void = (size_r[None, :] < window - d) | (size_l[None, :] < d)
        key = np.where(void, -1 - np.arange(m)[None, :], key)
        order = np.argsort(key, axis=1, kind="stable")
        ranked = np.take_along_axis(key, order, axis=1)
        equal = ranked[:, 1:] == ranked[:, :-1]
        twice = np.zeros_like(void)
        # the order is stable, so the first of equal keys is the earliest context
        twice[:, 1:] |= equal
        if not first_stays:
            twice[:, :-1] |= equal
        hit = np.zeros_like(void)
        np.put_along_axis(hit, order, twice, axis=1)
        for row, i in zip(*np.nonzero(hit)):
            spans[i].append((int(turns[a + row]), int(ends[a + row])))
    for i in single:
        at = contexts[i][1]
        out[i] = merged([(at - high + 1, at - low + window) for low, high in spans[i]])
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending ranges of the same bytes; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            if high > out[-1][1]:
                out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


# -- the distributed operator --------------------------------------------------


def _squeezed(keyed: DataFrame) -> DataFrame:
    """(uid, z): bodies as zstd frames, which halves what a shuffle moves."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(pack, batch.column(1).to_pylist()), pa.binary())], names=["uid", "z"])

    return keyed.select("uid", "body").mapInArrow(lean(run), "uid long, z binary")


def _contexts(texts: DataFrame, window: int) -> DataFrame:
    """Contexts of the anchors listed with each text: (h, e1, e2, uid, lo, at, bytes, crowded)."""

    def run(batches):
        import xxhash
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        digest = xxhash.xxh3_128_intdigest
        names = ["h", "e1", "e2", "uid", "lo", "at", "bytes", "crowded"]
        kinds = [pa.int64()] * 6 + [pa.binary(), pa.bool_()]
        for whole in batches:
            for batch in slices(whole, 128):
                cols: list[list] = [[] for _ in names]
                for uid, z, found in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                    body = unpack(z)
                    for a in found:
                        span = a["span"]
                        pos = span >> 2 * _BITS
                        lo = pos - (span >> _BITS & (1 << _BITS) - 1)
                        piece = body[lo : lo + (span & (1 << _BITS) - 1) + window]
                        e = digest(piece, pos - lo)
                        for col, value in zip(cols, (a["h"], (e >> 64) - (1 << 63), (e & ((1 << 64) - 1)) - (1 << 63), uid, lo, pos - lo, piece, a["crowded"])):
                            col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return texts.select("uid", "z", "found").mapInArrow(lean(run), "h long, e1 long, e2 long, uid long, lo long, at long, bytes binary, crowded boolean")


def _sorted_groups(contexts: DataFrame, window: int, first_stays: bool = False) -> DataFrame:
    """Ranges (uid, low, high) of the contexts, one anchor gram at a time; rows come in order of gram and context hash."""

    def run(batches):
        now, members = None, []
        out: list[list[int]] = [[], [], []]

        def close():
            if len(members) < 2:
                return
            members.sort()
            distinct: dict[tuple[bytes, int], int] = {}
            of = [distinct.setdefault((piece, at), len(distinct)) for _, _, at, piece in members]
            counts = [0] * len(distinct)
            for k in of:
                counts[k] += 1
            ranges = repeated_ranges(list(distinct), counts, window, first_stays)
            seen: set[int] = set()
            for (uid, pos, at, piece), k in zip(members, of):
                again = first_stays and k in seen
                seen.add(k)
                for low, high in [(0, len(piece))] if again else ranges[k]:
                    out[0].append(uid)
                    out[1].append(pos - at + low)
                    out[2].append(pos - at + high)

        def emit():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["uid", "low", "high"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for h, uid, lo, at, piece in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                if h != now:
                    close()
                    now, members = h, []
                members.append((uid, lo + at, at, piece))
            if len(out[0]) > 10_000:
                yield emit()
        close()
        yield emit()

    ordered = contexts.select("h", "uid", "lo", "at", "bytes").repartition("h").sortWithinPartitions("h")
    return ordered.mapInArrow(lean(run), "uid long, low long, high long")


def _salted(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``, one row a key, the rows of each key dealt into ``_SALTS`` parts."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64("uid", "lo"), F.lit(_SALTS)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(_SALTS)])))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _single_strings(contexts: DataFrame, window: int, first_stays: bool = False) -> DataFrame:
    """Ranges of the crowded anchors: equal contexts by their hash, the strings of distinct ones by theirs."""
    place = F.struct("uid", "lo")
    same = contexts.groupBy("h", "e1", "e2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    joined = _salted(contexts, same, ["h", "e1", "e2"], "left").withColumn("high", F.col("lo") + F.length("bytes"))
    again = F.col("n").isNotNull() & ((place != F.col("first")) if first_stays else F.lit(True))
    whole = joined.where(again).select("uid", F.col("lo").alias("low"), "high")
    firsts = joined.where(F.col("n").isNull() | (place == F.col("first"))).withColumn("n", F.coalesce("n", F.lit(1)))

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_intdigest
        for whole_ in batches:
            for batch in slices(whole_, 64):
                cols: list[list[int]] = [[], [], [], [], []]
                for uid, lo, n, piece in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                    for s in range(len(piece) - window + 1):
                        e = digest(piece[s : s + window])
                        for col, value in zip(cols, ((e >> 64) - (1 << 63), (e & ((1 << 64) - 1)) - (1 << 63), uid, lo + s, n)):
                            col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["w1", "w2", "uid", "lo", "n"])

    strings = firsts.select("uid", "lo", "n", "bytes").mapInArrow(lean(run), "w1 long, w2 long, uid long, lo long, n long")
    twice = strings.groupBy("w1", "w2").agg(F.count("*").alias("c"), F.min(place).alias("earliest")).where("c > 1").drop("c")
    hit = _salted(strings if first_stays else strings.where("n = 1"), twice, ["w1", "w2"])
    if first_stays:
        hit = hit.where(place != F.col("earliest"))
    return whole.unionByName(hit.select("uid", F.col("lo").alias("low"), (F.col("lo") + window).alias("high")))


def keyed_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, uid, k1, k2, body): all columns as one struct, the row's place in the stored table, hashes of the bytes, and the bytes."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("body"))
    return rows.select("row", F.monotonically_increasing_id().alias("uid"), F.xxhash64("body").alias("k1"), F.xxhash64(F.lit(1), F.col("body")).alias("k2"), "body")


def repeated_spans(keyed: DataFrame, *, window: int = WINDOW, crowded: int = CROWDED, first_stays: bool = False) -> DataFrame:
    """(uid, k1, whole, spans) of the texts with something to remove, as a stored table; ``whole`` if the text itself repeats (with ``first_stays``: an earlier one).

    ``keyed`` comes from ``keyed_texts`` over a stored table: it is read several
    times and its rows must keep their places, which ``k1`` proves when the
    result is joined.
    """
    with scratch(keyed.sparkSession):
        return materialise(_repeated_spans(keyed, window, crowded, first_stays), "spans", keep=True)


def _repeated_spans(keyed: DataFrame, window: int, crowded: int, first_stays: bool) -> DataFrame:
    keys = keyed.select("uid", "k1", "k2", F.length("body").cast("long").alias("n")).where(F.col("n") >= window)
    copies = keys.groupBy("k1", "k2").agg(F.min("uid").alias("first"), F.count("*").alias("c"))
    leads = F.col("uid") == F.col("first")
    texts = keys.join(copies, ["k1", "k2"]).select("uid", "k1", leads.alias("leads"), (~leads if first_stays else F.col("c") > 1).alias("whole"))
    texts = materialise(texts, "texts")
    found = materialise(_anchor_rows(keyed, window), "anchors")
    place = F.xxhash64("k1", F.shiftright("span", 2 * _BITS))
    # stored, so that both sides of the join are plain exchanges and a hot gram's rows can be split
    shared = found.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a <> b").select("h", (F.col("n") > crowded).alias("crowded"))
    shared = materialise(shared, "shared")
    # it grows with the corpus, so it is never broadcast
    listed = found.join(shared.hint("merge"), "h").groupBy("uid").agg(F.collect_list(F.struct("h", "span", "crowded")).alias("found"))
    leading = materialise(listed.join(texts.where("leads").select("uid"), "uid", "left_semi"), "listed")

    every = _contexts(_squeezed(keyed).join(leading.hint("merge"), "uid"), window)
    hot = not leading.where(F.exists("found", lambda a: a["crowded"])).isEmpty()
    if hot:
        # read by both ways below
        every = materialise(every, "contexts")
    ranges = _sorted_groups(every.where("not crowded"), window, first_stays)
    if hot:
        ranges = ranges.unionByName(_single_strings(every.where("crowded"), window, first_stays))
    spans = ranges.groupBy("uid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return texts.where("leads or whole").join(spans, "uid", "left").where("whole or spans is not null").select("uid", "k1", "whole", "spans")


def nested_spans(keyed: DataFrame, *, window: int = WINDOW, inner: int = PASSAGE, crowded: int = CROWDED) -> DataFrame:
    """(uid, k1, whole, spans, wide): as ``repeated_spans`` with a window of ``inner``, and in ``wide`` the ranges for ``window`` bytes, ``inner`` at least.

    A text that is ``whole`` and has ``window`` bytes repeats in that length too; its ``wide`` need not say so.
    """
    with scratch(keyed.sparkSession):
        spans = materialise(_repeated_spans(keyed, inner, crowded, False), "inner")
        runs = materialise(_long_runs(keyed, spans, window), "runs")
        again = _repeated_spans(runs, window, crowded, False)
        shifted = F.transform("spans", lambda s: F.struct((s["low"] + F.col("at")).alias("low"), (s["high"] + F.col("at")).alias("high")))
        every = F.array(F.struct(F.col("at").alias("low"), (F.col("at") + F.length("body")).alias("high")))
        placed = runs.join(again.drop("k1").hint("merge"), "uid").select("src", F.when(F.col("whole"), every).otherwise(shifted).alias("wide"))
        wide = placed.groupBy(F.col("src").alias("uid")).agg(F.flatten(F.collect_list("wide")).alias("wide"))
        return materialise(spans.join(wide.hint("merge"), "uid", "left"), "spans", keep=True)


def _long_runs(keyed: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(uid, src, at, k1, k2, body): the runs of at least ``window`` bytes that ``spans`` cover, as texts of their own, and where in which text they lie.

    Of equal texts only the first has spans, so it takes part for all.
    """

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for whole_ in batches:
            for batch in slices(whole_):
                cols: list[list] = [[], [], []]
                for uid, z, found in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                    long = [(low, high) for low, high in merged([(s["low"], s["high"]) for s in found]) if high - low >= window]
                    body = unpack(z) if long else b""
                    for low, high in long:
                        for col, value in zip(cols, (uid, low, body[low:high])):
                            col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["src", "at", "body"])

    # no run is longer than all ranges together
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    some = spans.where(covered >= window).select("uid", "spans")
    cut = _squeezed(keyed).join(some.hint("merge"), "uid").select("uid", "z", "spans").mapInArrow(lean(run), "src long, at long, body binary")
    return cut.select(F.monotonically_increasing_id().alias("uid"), "src", "at", F.xxhash64("body").alias("k1"), F.xxhash64(F.lit(1), F.col("body")).alias("k2"), "body")


def _joined(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` (uid, k1, ...) with ``whole`` and ``spans``; an error where a place holds another text than before."""
    joined = rows.join(spans.withColumnRenamed("k1", "_k1").hint("merge"), "uid", "left")
    moved = F.col("_k1").isNotNull() & (F.col("_k1") != F.col("k1"))
    return joined.withColumn("whole", F.when(moved, F.raise_error(F.lit("the table's rows changed places")).cast("boolean")).otherwise(F.col("whole")))


def cut_spans(body: bytes, whole: bool | None, spans: list | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is kept of a text and its removed runs."""
    runs = [(0, len(body))] if whole else merged([(s["low"], s["high"]) for s in spans or []])
    kept, at = [], 0
    for low, high in runs:
        kept.append(body[at:low])
        at = high
    return b"".join([*kept, body[at:]]), runs


def remove_repeats(docs: DataFrame, *, text_col: str = "text", window: int = WINDOW, first_stays: bool = False) -> DataFrame:
    """All rows and columns of a stored table, each text without its repeated bytes; a character that is cut goes whole.

    A column ``n_chars`` is set to the new length. A null text stays null.
    """
    keyed = keyed_texts(docs, text_col)
    names = docs.columns
    rest = [c for c in names if c != text_col]
    fields = [F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(rest)]
    void = F.col("row").getField(text_col).isNull()
    rows = _squeezed_rows(keyed.select(F.struct(*fields, void.alias("void")).alias("row"), "uid", "k1", "body"))
    joined = _joined(rows, repeated_spans(keyed, window=window, first_stays=first_stays))

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for whole_ in batches:
            for batch in slices(whole_):
                out = []
                for void, z, whole, spans in zip(*[batch.column(len(rest) + k).to_pylist() for k in range(4)]):
                    out.append(None if void else cut_spans(unpack(z), whole, spans)[0].decode("utf-8", "ignore"))
                cols = {c: batch.column(k) for k, c in enumerate(rest)} | {text_col: pa.array(out, pa.string())}
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    flat = [F.col("row").getField(f"c{i}").alias(f"c{i}") for i in range(len(rest))]
    cut = joined.select(*flat, F.col("row.void").alias("void"), "z", "whole", "spans").mapInArrow(lean(run), docs.schema)
    return cut.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else cut


def _squeezed_rows(keyed: DataFrame) -> DataFrame:
    """(row, uid, k1, z) of ``keyed`` (row, uid, k1, body): what is joined by place moves with a compressed text."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(map(pack, batch.column(3).to_pylist()), pa.binary())], names=["row", "uid", "k1", "z"])

    schema = T.StructType([keyed.schema["row"], T.StructField("uid", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("z", T.BinaryType())])
    return keyed.select("row", "uid", "k1", "body").mapInArrow(lean(run), schema)


def op2_suffix_array_dedup(spark, sf_dir):
    """Contract query: bytes removed from each document and the digest of what is left.

    ``n_passage_bytes`` beside them counts the bytes covered by strings of ``PASSAGE`` bytes that repeat, none of which is removed for that:
    passages of just over 50 words are mostly met by it and often too short for the contract's strings. ``n_passages`` counts the runs of such bytes that
    hold at least ``PASSAGE_WORDS`` words, those that are cut at its ends included.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    keyed = keyed_texts(docs).select(F.col("row.doc_id").alias("row"), "uid", "k1", "k2", "body")
    joined = _joined(_squeezed_rows(keyed), nested_spans(keyed))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages"]

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for whole_ in batches:
            for batch in slices(whole_):
                rows = []
                for z, whole, spans, wide in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3, 4)]):
                    body = unpack(z)
                    kept, runs = cut_spans(body, whole and len(body) >= WINDOW, wide)
                    rest, again = cut_spans(body, whole, spans)
                    passages = sum(len(body[low:high].split()) >= PASSAGE_WORDS for low, high in again)
                    rows.append((len(body), len(body) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), len(body) - len(rest), passages))
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.StringType() if n == "kept_sha256" else T.LongType()) for n in names[1:]]])
    return joined.select("row", "z", "whole", "spans", "wide").mapInArrow(lean(run), schema)
