"""Near copies: SimHash fingerprints compared bit-sliced at a wide radius, each link confirmed by exact likeness.

Two texts are near copies if the sets of their five-word shingles have a Jaccard
likeness of 0.8 or more. Their SimHash fingerprints then differ in 9.7 of 64 bits
on average (standard deviation 2.9), so the radius is 24: more than four standard deviations above, also for
texts of few shingles. At such a radius blocks of agreeing bits file nothing (25 blocks of two
or three bits), so texts are filed by 24 bands of 5 minimum hashes of the same shingles: two of likeness 0.8 share
a file with a chance of 0.99993, more alike ones with a higher one.

Texts of the same shingle set are one class and take part once. Classes that
are connected by files form a group. The members of a group that fits a run (``RUN``
members) meet once and each is compared with each. A larger group is dealt into runs by
hash, as a whole or file by file, whichever gives fewer comparisons; what the links within the
runs do not connect with most of the group (file) is then compared with all its runs. So a large group of
copies costs ``RUN`` comparisons a member, plus those left apart against the whole. A run's
fingerprints stand in bit planes (``simhash.close_pairs``), and only pairs within the radius have their shared
shingles counted. Runs give spanning forests, not pairs. Texts move compressed, and only those of groups move to runs.

Defined results: words are separated by ASCII white space, in lower case (ASCII); a text of fewer than five words
is one shingle; null, empty and blank texts have the empty set and are one class. A null id stays
only where all ids of the component are null. An empty table gives no rows. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.common import append_columns, lean, materialise, scratch, slices
from spanforge.llm.components import connected_components
from spanforge.llm.simhash import close_pairs, majority

WORDS = 5
#: Least likeness as a fraction of whole numbers: 4 / 5.
LEAST = (4, 5)
RADIUS = 24
BANDS, ROWS = 24, 5
SEED = 42
#: Members of a run, and shingles of all of them.
RUN = 1024
RUN_SHINGLES = 1 << 20
#: Shingles whose hashes are held at once; rows and bytes of whole runs that are compared at once.
_STEP = 2048
_HELD_ROWS, _HELD_BYTES = 2048, 1 << 24


def shingles(text: bytes | None, width: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    return np.unique(np.array([digest(s, SEED) for s in map(b" ".join, zip(*[words[i:] for i in range(width)]))], dtype=np.uint64))


def banding():
    """A function from a shingle set to its band keys."""
    import xxhash

    rng = np.random.default_rng(SEED)
    mult, add = (rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))

    def keys(hashes: np.ndarray) -> np.ndarray:
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(hashes), _STEP):
            np.minimum(least, (mult[:, None] * hashes[None, at : at + _STEP] + add[:, None]).min(axis=1), out=least)
        return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)

    return keys


def filed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns with ``set`` (the mark of the shingle set), ``size``, ``fp`` (SimHash of the set), ``bands`` and ``z`` (the text's bytes as a zstd frame)."""

    def make():
        import xxhash
        import zstandard

        keys, pack = banding(), zstandard.ZstdCompressor(level=3).compress

        def run(texts):
            sets = [shingles(t) for t in texts]
            marks = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            prints = np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            return [marks, [len(s) for s in sets], prints, [keys(s) if len(s) else [] for s in sets], [pack(t or b"") for t in texts]]

        return run

    return append_columns(docs, text_col, [("set", T.LongType()), ("size", T.LongType()), ("fp", T.LongType()), ("bands", T.ArrayType(T.LongType())), ("z", T.BinaryType())], make, as_bytes=True)


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common members of the sets ``i`` and ``j``, pair by pair; by products of incidence blocks where there are many pairs."""
    if len(i) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], dtype=np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = often[column] > 1
    row, column = row[keep], np.unique(column[keep], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    counts = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        block = np.zeros((len(sets), 4096), dtype=np.float32)
        block[row[a:b], column[a:b] - low] = 1
        counts += block @ block.T
    return counts[i, j].astype(np.int64)


def forest(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that links connect each of ``count`` places with."""
    label = np.arange(count)
    while len(i):
        before = label.copy()
        np.minimum.at(label, j, label[i])
        np.minimum.at(label, i, label[j])
        label = label[label]
        if (label == before).all():
            break
    return label


def compared(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """Forests (a, b) of the near copies within each run of ``runs`` (u, v, w, set, fp, size, root); pairs of one root are taken as linked."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            whole = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([whole.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            upto = len(key) if last else (int(cuts[-1]) if len(cuts) else 0)
            held[:] = whole.slice(upto).to_batches()
            if not upto:
                return
            bounds = np.concatenate(([0], cuts[cuts < upto], [upto]))
            mark, fp, size, root = (whole.column(k).to_numpy()[:upto] for k in range(3, 7))
            body = whole.column(7)
            i, j = close_pairs(fp.view(np.uint64), bounds, RADIUS)
            fit = LEAST[1] * np.minimum(size[i], size[j]) >= LEAST[0] * np.maximum(size[i], size[j])
            fit &= (root[i] != root[j]) & (mark[i] != mark[j])
            i, j = i[fit], j[fit]
            if not len(i):
                return
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            found = []
            for low, high in zip(bounds[:-1], bounds[1:]):
                a, b = np.searchsorted(i, [low, high])
                if a == b:
                    continue
                used, places = np.unique(np.concatenate((i[a:b], j[a:b])), return_inverse=True)
                x, y = places[: b - a], places[b - a :]
                sets = [shingles(unpack(body[int(k)].as_py())) for k in used]
                both = shared_counts(sets, x, y)
                lengths = np.array([len(s) for s in sets])
                near = LEAST[1] * both >= LEAST[0] * (lengths[x] + lengths[y] - both)
                label = forest(len(used), x[near], y[near])
                leaf = np.flatnonzero(label != np.arange(len(used)))
                found.append((mark[used[leaf]], mark[used[label[leaf]]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"])

        for batch in batches:
            for start in range(0, batch.num_rows, _STEP):
                held.append(batch.slice(start, _STEP))
                if sum(b.num_rows for b in held) >= _HELD_ROWS or sum(b.column(7).nbytes for b in held) >= _HELD_BYTES:
                    yield from flush(False)
        if held:
            yield from flush(True)

    whole = runs.join(texts, "set").select("u", "v", "w", "set", "fp", "size", "root", "z")
    return whole.repartition("u", "v", "w").sortWithinPartitions("u", "v", "w").mapInArrow(lean(run), "a long, b long")


def _runs_of(count, size):
    """The number of runs that so many members of so many shingles need."""
    return F.ceil(F.greatest(count / F.lit(RUN), size / F.lit(RUN_SHINGLES), F.lit(1.0))).cast("int")


def linked(stored: DataFrame) -> DataFrame:
    """(node, root) of the sets that have a near copy; ``stored`` is (set, size, fp, bands, z, place), any rows a set."""
    rows = stored.where("size > 0").select("set", F.explode("bands").alias("key"))
    # files of more than one set. This and other tables below grow with the corpus: they are merged, never broadcast
    heads = materialise(rows.groupBy("key").agg(F.min("set").alias("head"), F.max("set").alias("last")).where("head <> last").drop("last"), "heads")
    files = materialise(rows.join(heads.hint("merge"), "key").distinct(), "files")
    # a set is tied to the least of its files' heads (one a band), and that one to the others
    tied = files.groupBy("set").agg(F.collect_set("head").alias("heads"))
    ties = tied.select(F.array_min("heads").alias("a"), F.explode(F.array_append("heads", F.col("set"))).alias("b"))
    groups = connected_components(ties)
    found = stored.select("set", "size", "fp", "place").join(groups, F.col("set") == F.col("node")).groupBy("set").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.min("place").alias("place"), F.first("root").alias("group"))
    found = materialise(found, "found")
    texts = materialise(stored.select("place", "z").join(found.select("set", "place").hint("merge"), "place").select("set", "z"), "texts")
    members = found.drop("place")
    wide = members.groupBy("group").agg(F.count("*").alias("count"), _runs_of(F.count("*"), F.sum("size")).alias("runs"))
    members = materialise(members.join(wide, "group"), "members")
    none = F.lit(0).cast("long")
    small = members.where("runs = 1").select(F.col("group").alias("u"), none.alias("v"), none.alias("w"), "set", "fp", "size", F.col("set").alias("root"))
    links = materialise(compared(small, texts), "links")
    large = members.where("runs > 1")
    if large.isEmpty():
        return connected_components(links)

    # a large group as a whole or file by file: ``n`` comparisons a row of a file, ``count`` a row of the group
    filed_ = files.join(files.groupBy("key").agg(F.count("*").alias("n")), "key").join(large.select("set", "size", "fp", "group", "count"), "set")
    costs = filed_.groupBy("group").agg(F.sum("n").alias("cost"), F.first("count").alias("count")).select("group", (F.col("cost") < F.col("count") * F.col("count")).alias("split"))
    split = filed_.join(costs.where("split"), "group").select(F.col("key").alias("unit"), "set", "size", "fp")
    units = materialise(large.join(costs.where("not split"), "group").select(F.col("group").alias("unit"), "set", "size", "fp").unionByName(split), "large")
    sizes = units.groupBy("unit").agg(_runs_of(F.count("*"), F.sum("size")).alias("runs"))
    dealt = units.join(sizes, "unit").withColumn("run", F.pmod(F.xxhash64("set", "unit"), F.col("runs").cast("long")))
    within = dealt.select(F.col("unit").alias("u"), F.col("run").alias("v"), none.alias("w"), "set", "fp", "size", F.col("set").alias("root"))
    links = links.unionByName(materialise(compared(within, texts), "links"))
    roots = connected_components(links)

    # what is not connected with most of its unit, against all runs of the unit
    named = materialise(dealt.where("runs > 1").join(roots, F.col("set") == F.col("node"), "left").select("unit", "run", "runs", "set", "fp", "size", F.coalesce("root", "set").alias("root")), "named")
    most = named.groupBy("unit", "root").agg(F.count("*").alias("n")).groupBy("unit").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    apart = named.join(most, "unit").where("root <> main").drop("main")
    need = apart.groupBy("unit").agg(_runs_of(F.count("*"), F.sum("size")).alias("others"))
    apart = apart.join(need, "unit").withColumn("other", F.pmod(F.xxhash64("set", "unit", F.lit(1)), F.col("others").cast("long")))
    one = apart.withColumn("run", F.explode(F.sequence(none, F.col("runs").cast("long") - 1)))
    two = named.join(need, "unit").withColumn("other", F.explode(F.sequence(none, F.col("others").cast("long") - 1)))
    tiles = one.unionByName(two.select(*one.columns)).select(F.col("unit").alias("u"), F.col("run").alias("v"), F.col("other").alias("w"), "set", "fp", "size", "root").distinct()
    return connected_components(links.unionByName(materialise(compared(tiles, texts), "links")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of least id stays, of equal ids one."""
    names = docs.columns
    rest = [c for c in names if c != text_col]
    text = F.col(f"`{text_col}`")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], text.isNull().alias("void"))
    marked = filed(docs.select(row.alias("row"), text.alias("text"))).select("row", "z", "set", "size", "fp", "bands", F.monotonically_increasing_id().alias("place"))
    stored = materialise(marked, "shingles")
    with scratch(docs.sparkSession):
        doc_id = F.col("row").getField(f"c{rest.index(id_col)}")
        found = stored.select("set", doc_id.alias("doc_id"), "place").join(linked(stored), F.col("set") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set"))
        # without the rows that are alone
        best = found.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("best")).where("n > 1")
        gone = found.join(best, "root").where(F.col("place") != F.col("best.place")).select("place")
        gone = materialise(gone, "gone", keep=True)
    kept = stored.select("place", "row", "z").join(gone.hint("merge"), "place", "left_anti")

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for batch in slices(whole):
                out = [None if void else unpack(z).decode("utf-8") for z, void in zip(batch.column(len(rest)).to_pylist(), batch.column(len(rest) + 1).to_pylist())]
                cols = {c: batch.column(k) for k, c in enumerate(rest)} | {text_col: pa.array(out, pa.string())}
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    flat = [F.col("row").getField(f"c{i}").alias(f"c{i}") for i in range(len(rest))]
    return kept.select(*flat, "z", F.col("row.void").alias("void")).mapInArrow(lean(run), docs.schema)
