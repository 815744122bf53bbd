"""Token ids of whole texts, flat token files, and token counts by a separator scan.

``UnitEncoder`` gives the ids of the byte-level BPE file of the ``tokenizers``
library. Between two characters that are not white space a single space always
begins a new pre-token and a single line feed is one, so a text falls apart
into units that can be encoded alone and remembered. A text with other runs of
white space is encoded as a whole by the same ranks; one that holds a special
token's string goes to the ``tokenizers`` library itself.

A flat token file is a row of unsigned 16-bit little-endian ids with the
end-of-document id after each document and no index; in the texts the string of
that token is ordinary text, so no text gives the id. ``scan_token_files`` finds
the documents: each file is read in blocks, the separator search of a block is
one vectorised comparison, and a prefix scan over the blocks' summaries (number
of separators, place of the last one) gives each block its first document's number and
the tokens carried into it, so documents may span any number of blocks.

Defined results: a null text is the empty text, a document of no tokens; an
empty table gives an empty table. Repeated rows and ids count each. Tokens after
a file's last separator form a last document marked ``closed`` = false.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import documents, lean, shared_dir, slices

END_OF_DOCUMENT = 50256
#: Bytes of a token file that one vectorised search covers.
BLOCK_BYTES = 1 << 20
#: Documents of one token file: a task goes on with a further file, so files stay small and are read by tasks of their own.
DOCS_PER_FILE = 20_000
#: Units that an encoder remembers before it starts anew.
MEMO_UNITS = 600_000
SPECIAL = "<|endoftext|>"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Units(dict):
    """Unit to packed ids, filled on first use; None for a unit that cannot be encoded alone."""

    def __init__(self, pack, limit: int):
        super().__init__()
        self.pack, self.limit = pack, limit

    def __missing__(self, unit: str) -> bytes | None:
        if len(self) >= self.limit:
            self.clear()
        fed = unit[:1] == "\n"
        body = unit[1:] if fed else unit
        if not body or body[0].isspace() or body[-1].isspace():
            packed = None
        elif len(body) > 1 and body[-1] in ".," and body[-2].isalpha():
            packed = self[unit[:-1]]
            packed = packed and packed + self.pack(body[-1])
        else:
            packed = self.pack(unit if fed else " " + unit)
        self[unit] = packed
        return packed


def encode_by_units(text: str, pack, unit) -> bytes:
    """Packed ids of a text that is not empty, by units where its white space allows it and else as a whole."""
    first, *rest = text.replace("\n", " \n").split(" ")
    if not first or first[0].isspace() or first[-1].isspace():
        return pack(text)
    try:
        return pack(first) + b"".join(map(unit, rest))
    except TypeError:
        return pack(text)


class UnitEncoder:
    """Text to packed little-endian 32-bit ids, with units remembered."""

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None, memo: int = MEMO_UNITS):
        import public_tokenizers
        import tiktoken

        self.json_path = json_path or tokenizer_path("byte_bpe_50k.json")
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")), special_tokens={})
        self.ids = encoding.encode_ordinary
        self.unit = Units(self._pack, memo).__getitem__
        self.library = None

    def _pack(self, text: str) -> bytes:
        return array("I", self.ids(text)).tobytes()

    def encode(self, text: str | None, special: bool = True) -> bytes:
        """The packed ids; without ``special`` the string of a special token is ordinary text."""
        if not text:
            return b""
        if special and SPECIAL in text:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.json_path)
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return encode_by_units(text, self._pack, self.unit)


_encoder: UnitEncoder | None = None


def encoder() -> UnitEncoder:
    """The worker process's encoder with the default files; tasks that follow find its units remembered."""
    global _encoder
    if _encoder is None:
        _encoder = UnitEncoder()
    return _encoder


def write_token_files(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", eod: int = END_OF_DOCUMENT, docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """Write the texts of ``docs`` as flat token files under ``path``; returns their order as (file_no, document, id).

    Each task writes files of ``docs_per_file`` documents through Spark's own writer: the row separator is the
    end-of-document id. ``document`` counts on over a task's files. ``docs`` must be read from storage (no shuffle between), so
    that its partitions are the same when the order is read.
    """
    separator = int(eod).to_bytes(2, "little").decode("latin-1")
    rows = docs.select(F.col(text_col).cast("string").alias("t"))

    def encode(batches):
        texts_to_ids = encoder().encode
        for whole in batches:
            for batch in slices(whole):
                out = []
                for text in batch.column(0).to_pylist():
                    ids = np.frombuffer(texts_to_ids(text, special=False), dtype="<u4")
                    if (ids >= 1 << 16).any() or (ids == eod).any():
                        raise ValueError("an id does not fit a 16-bit file or equals the separator")
                    out.append(ids.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    tokens = rows.mapInArrow(lean(encode), "value binary").select(F.col("value").cast("string").alias("value"))
    tokens.write.option("maxRecordsPerFile", docs_per_file).option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)
    at = F.monotonically_increasing_id()
    return docs.select(F.shiftright(at, 33).cast("int").alias("file_no"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("document"), F.col(id_col).alias(id_col))


def scan_block(ids: np.ndarray, eod: int) -> tuple[int, int, list[int]]:
    """Number of separators, place of the last one (-1: none), and the lengths of documents that end here, the first counted from the block's start."""
    ends = np.flatnonzero(ids == eod)
    if not len(ends):
        return 0, -1, []
    return len(ends), int(ends[-1]), np.diff(ends, prepend=-1).__sub__(1).tolist()


def scan_token_files(spark, path: str, *, eod: int = END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES, docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """Documents of the flat token files under ``path``: (file_no, file, document, n_tokens, closed).

    ``document`` counts from 0 in each file, or over the files of one task where Spark's names
    tell them; ``file_no`` is the task's number in such a name, or null. A file is one task's input: one that was not
    written here must not exceed 2 GiB.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    step = max(2, block_bytes // 2 * 2)

    def scan(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                rows = []
                if data.size % 2:
                    raise ValueError(f"{name} is not a row of 16-bit ids")
                for block, start in enumerate(range(0, data.size, step)):
                    ids = np.frombuffer(data, dtype="<u2", offset=start, count=min(step, data.size - start) // 2)
                    rows.append((block, start // 2, len(ids), *scan_block(ids, eod)))
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows))] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "block", "start", "size", "n", "last", "lengths"])

    blocks = files.mapInArrow(lean(scan), "file string, block int, start long, size long, n long, last long, lengths array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    ended = F.max(F.when(F.col("last") >= 0, F.col("start") + F.col("last") + 1))
    stitched = blocks.withColumns(
        {
            "base": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "carry": F.col("start") - F.coalesce(ended.over(before), F.lit(0)),
            "open": F.sum("size").over(whole) - F.coalesce(ended.over(whole), F.lit(0)),
            "all": F.sum("n").over(whole),
        }
    )
    number, further = F.regexp_extract("file", r"part-(\d+)", 1), F.regexp_extract("file", r"part-\d+-.*-c(\d+)\.[^/]*$", 1)
    file_no = F.when(number != "", number.cast("int")).alias("file_no")
    before_file = F.when(further != "", further.cast("long") * docs_per_file).otherwise(0)
    closed = stitched.select(file_no, "file", "base", "carry", F.posexplode("lengths").alias("i", "n")).select(
        "file_no", "file", (before_file + F.col("base") + F.col("i")).alias("document"), (F.col("n") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed")
    )
    rest = stitched.where("block = 0 and open > 0").select(file_no, "file", (before_file + F.col("all")).alias("document"), F.col("open").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def op1_token_counts(spark, sf_dir):
    """Contract query: the documents as flat token files, their counts by the separator scan, joined to the ids by place."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    path = shared_dir(spark, "token-files")
    order = write_token_files(docs, path)
    counts = scan_token_files(spark, path).select("file_no", "document", "n_tokens")
    joined = order.join(counts, ["file_no", "document"], "full")
    checked = F.when(F.col("n_tokens").isNull() | F.col("document").isNull(), F.raise_error(F.lit("token files and their order differ"))).otherwise(F.col("n_tokens"))
    return joined.select("doc_id", checked.alias("n_tokens"))
