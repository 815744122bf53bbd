"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the encoding of its bytes exactly if every pair of
neighbours is the encoding of the two tokens' bytes. So after each byte just one
token sequence encodes what was read, and its last token is found among the
tokens that end there by a test of one pair. The transducer reads bytes and
follows all hypotheses about the current token at once; its states and moves
are made when first reached, so the merges are compiled as far as the texts need
them. A hypothesis lives no longer than the longest token, so the lookahead is
bounded and long inputs are emitted as they are read.

A match of the pattern that is itself a token is that token, as in the public
library. Decoding streams the tokens' bytes through ``Utf8Decoder``, an incremental UTF-8 state
machine that gives text as soon as it is complete, so a token may end inside a character.

Defined results: null and empty texts have no ids. An id that is no token is an error.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanforge.llm.common import append_columns, documents
from spanforge.llm.tokens import Units, encode_by_units, load_ranks, tokenizer_path

#: Units of text whose ids are remembered, and pairs of tokens, before either is built anew.
MEMO_UNITS = 1_000_000
MEMO_PAIRS = 1_000_000


def merge_bytes(piece: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[int]:
    """Ids by repeatedly merging the neighbours of least rank, the leftmost on a tie, down to ``stop`` parts."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > stop:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes to token ids with bounded lookahead.

    The hypotheses about the token being read are the suffixes of the input that
    are paths of the vocabulary's trie. All of them follow from the longest, so
    a set of hypotheses is one state: that trie node. Its moves and the tokens that end
    in it are worked out when first needed. After each byte the output is the last
    token of the encoding so far: the one token ending here that fits the
    encoding of what stands before it. Tokens are settled where the encodings at
    all starts of living hypotheses agree, at most one token length behind.
    """

    #: Bytes after which settled tokens are emitted.
    span = 4096

    def __init__(self, ranks: dict[bytes, int], pairs: int = MEMO_PAIRS):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.limit = pairs
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        for piece, number in ranks.items():
            node = 0
            for byte in piece:
                at = self.child.setdefault(node << 8 | byte, len(self.token_at))
                if at == len(self.token_at):
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = at
            self.token_at[node] = number
        self.shorter: dict[int, int] = {0: 0}
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {0: ()}
        self.moves: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into ``token`` last; (-1, -1) for a byte; None where its bytes encode otherwise."""
        if token not in self.halves:
            piece = self.bytes_of[token]
            found = None
            if len(piece) == 1:
                found = (-1, -1)
            elif len(parts := merge_bytes(piece, self.ranks, stop=2)) == 2 and merge_bytes(piece, self.ranks) == [token]:
                found = (parts[0], parts[1])
            self.halves[token] = found
        return self.halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the pair is the encoding of its bytes; anything fits the start (-1).

        Merges are undone from the latest on. At each step the two parts that
        meet must not merge before the merge just undone; on equal ranks the
        left one comes first.
        """
        key = (left + 1) << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            found = self.pairs[key] = left < 0 or self._apart(left, right)
        return found

    def _apart(self, x: int, y: int) -> bool:
        limit = 1 << 62
        while True:
            joined = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
            if joined is not None and joined < limit:
                return False
            inner, outer = self._halves(x)[1], self._halves(y)[0]
            if inner < 0 and outer < 0:
                return True
            if outer < 0 or inner >= 0 and x > y:
                limit, x = x, inner
            else:
                limit, y = y + 1, outer

    def _next(self, node: int, byte: int) -> int:
        """The longest suffix of the node's path and ``byte`` that is a path."""
        at = node
        while True:
            found = self.child.get(at << 8 | byte)
            if found is not None:
                break
            if not at:
                raise ValueError("a byte has no token of its own")
            at = self.shorter[at]
        if found not in self.shorter:
            self.shorter[found] = self._next(self.shorter[at], byte) if at else 0
            rest = self._ends(self.shorter[found])
            token = self.token_at[found]
            self.ends[found] = ((token, self.depth[found]), *rest) if token >= 0 and self._halves(token) is not None else rest
        return found

    def _ends(self, node: int) -> tuple[tuple[int, int], ...]:
        return self.ends[node]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        after = self._next(state, byte)
        found = self.moves[state << 8 | byte] = (after, self.ends[after])
        return found

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pattern match."""
        out: list[int] = []
        state, moves, pairs = 0, self.moves, self.pairs
        # tokens[i]: the last token of the encoding of the first i bytes held
        tokens = [-1]
        for byte in piece:
            found = moves.get(state << 8 | byte)
            state, ends = found if found is not None else self._move(state, byte)
            for token, size in ends:
                before = tokens[-size]
                fit = pairs.get((before + 1) << 32 | token)
                if self.fits(before, token) if fit is None else fit:
                    tokens.append(token)
                    break
            else:
                raise ValueError("bytes without an encoding")
            if len(tokens) > self.span:
                settled = self._settled(tokens, self.depth[state])
                if settled:
                    out += self._chain(tokens, settled)
                    del tokens[:settled]
        return out + self._chain(tokens, len(tokens) - 1)

    def _chain(self, tokens: list[int], at: int) -> list[int]:
        out = []
        while at:
            out.append(tokens[at])
            at -= len(self.bytes_of[tokens[at]])
        return out[::-1]

    def _settled(self, tokens: list[int], reach: int) -> int:
        """The last place at which the encodings at all living starts have a token end."""
        starts = set(range(len(tokens) - 1 - reach, len(tokens)))
        while len(starts) > 1:
            last = max(starts)
            if not last:
                break
            starts.remove(last)
            starts.add(last - len(self.bytes_of[tokens[last]]))
        return starts.pop()


class _WholeTexts(dict):
    """Token id to its text, None where its bytes begin or end inside a character; worked out by the machine when first needed."""

    def __init__(self, pieces: list[bytes | None]):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, number: int) -> str | None:
        piece = self.pieces[number]
        if piece is None:
            raise KeyError(f"{number} is no token")
        stream = Utf8Decoder()
        text = stream.feed(piece)
        found = self[number] = text if not stream.due and text.encode("utf-8") == piece else None
        return found


class BpeCodec:
    """Encoder and decoder over a file of ranks."""

    def __init__(self, ranks_path: str | None = None, memo: int = MEMO_UNITS):
        import public_tokenizers
        import regex

        self.ranks = load_ranks(ranks_path or tokenizer_path("byte_bpe_multi_50k.tiktoken"))
        self.matches = regex.compile(public_tokenizers.PATTERN).findall
        self.transducer = Transducer(self.ranks)
        self.unit = Units(self._pack, memo).__getitem__
        size = max(self.ranks.values()) + 1
        self.pieces: list[bytes | None] = [None] * size
        for piece, number in self.ranks.items():
            self.pieces[number] = piece
        self.texts = _WholeTexts(self.pieces)

    def _pack(self, text: str) -> bytes:
        out = array("I")
        for match in self.matches(text):
            piece = match.encode("utf-8")
            whole = self.ranks.get(piece)
            if whole is None:
                out.extend(self.transducer.encode(piece))
            else:
                out.append(whole)
        return out.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return encode_by_units(text, self._pack, self.unit) if text else b""

    def decode(self, packed: bytes, portion: int = 8192) -> Iterator[str]:
        """The text of packed ids, in portions of that many ids: a stream through the UTF-8 machine.

        Between characters a token that is whole text goes through as it is; its text is
        remembered. Any other token is fed to the machine byte by byte.
        """
        stream, texts = Utf8Decoder(), self.texts
        for at in range(0, len(packed), 4 * portion):
            out = []
            for number in np.frombuffer(packed[at : at + 4 * portion], dtype="<u4").tolist():
                text = None if stream.due else texts[number]
                out.append(stream.feed(self.pieces[number]) if text is None else text)
            yield "".join(out)
        yield stream.close()


class Utf8Decoder:
    """Incremental UTF-8: ``feed`` returns the characters that are complete; bytes that cannot be UTF-8 become U+FFFD.

    The state is the number of continuation bytes still due, the range of the
    next one, and the bytes of the open character.
    """

    def __init__(self):
        self.open = bytearray()
        self.due, self.low, self.high = 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.due and not self.low <= byte <= self.high:
                out.append("�")
                self.open.clear()
                self.due = 0
            if self.due:
                self.open.append(byte)
                self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                if not self.due:
                    out.append(self.open.decode("utf-8"))
                    self.open.clear()
            elif byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                self.open.append(byte)
                self.due = 1 + (byte >= 0xE0) + (byte >= 0xF0)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        rest = "�" if self.due else ""
        self.open.clear()
        self.due = 0
        return rest


_codecs: dict[str | None, BpeCodec] = {}


def codec(ranks_path: str | None = None) -> BpeCodec:
    """The worker process's codec of a file; its states stay for the tasks that follow."""
    if ranks_path not in _codecs:
        _codecs[ranks_path] = BpeCodec(ranks_path)
    return _codecs[ranks_path]


def encode_column(docs: DataFrame, *, text_col: str = "text", out: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """All rows and columns with the packed ids of each text."""

    def make():
        encode = codec(ranks_path).encode
        return lambda texts: [[encode(t) for t in texts]]

    return append_columns(docs, text_col, [(out, T.BinaryType())], make)


def decode_column(docs: DataFrame, *, ids_col: str = "ids", out: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """All rows and columns with the text that packed ids decode to; a null gives an empty text."""

    def make():
        decode = codec(ranks_path).decode

        def run(values):
            found = []
            for packed in values:
                found.append("".join(decode(packed or b"")))
            return [found]

        return run

    return append_columns(docs, ids_col, [(out, T.StringType())], make, as_bytes=True)


def digests(docs: DataFrame, *, text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """All rows and columns with n_tokens, ids_sha256 and decoded_sha256 of a round trip."""

    def make():
        both = codec(ranks_path)

        def run(texts):
            counts, ids, decoded = [], [], []
            for text in texts:
                packed = both.encode(text)
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                digest = hashlib.sha256()
                for portion in both.decode(packed):
                    digest.update(portion.encode("utf-8"))
                decoded.append(digest.hexdigest())
            return [counts, ids, decoded]

        return run

    return append_columns(docs, text_col, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], make)


def op7_bpe_codec(spark, sf_dir):
    """Contract query: every document encoded, decoded, and digests of both."""
    return digests(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
