"""Personal data: fixed patterns, and spans added by a trained character tagger.

The base patterns (email, ip, card, phone) are matched from left to right without
overlap, each kind by itself; a match that fails its check is dropped.

The tagger is a bidirectional LSTM with CRF transitions over characters. It is trained
here, from windows of a bounded sample of documents in which the base's spans are
labelled and further labelled spans and look-alikes (numbers, hashes, versions, dates)
are planted. A span of any kind holds a digit or an at sign, so only stretches around those
outside base spans, with the run of other characters they stand in, are tagged: in windows that overlap by half, whose scores
are averaged before one path is decoded through the whole stretch. A decoded span is trimmed to
characters that its kind may begin and end with, and kept if every character is probable, it satisfies its kind's
wider check (``plausible``) and it overlaps no other span. So the tagger can add phone numbers without a plus,
card numbers with dots, and addresses with letters outside ASCII; an ip address
that the base lacks does not exist, as both take the same form.

Defined results: null and empty texts have no spans. Offsets are code points, ends
exclusive. Repeated rows are answered each.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.common import append_columns, documents
from spanforge.llm.tagger import Tagger, codes

KINDS = ("email", "ip", "card", "phone")
#: Documents that the tagger's training windows are cut from.
TRAINING_DOCUMENTS = 200
TRAINING_WINDOWS = 3000
#: Characters of a training document that the driver gets at most.
TRAINING_CHARS = 20_000
WINDOW = 64
STRIDE = 32
MARGIN = 24
CONFIDENCE = 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# digits are taken whole and begin at a run's start: the same matches without repeated scans of long runs
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
#: Characters other than white space that a stretch takes on both sides of a digit or at sign.
_REACH = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def valid(kind: str, text: str) -> bool:
    """A kind's own check of a span's text."""
    if kind == "email":
        return _EMAIL.fullmatch(text) is not None
    if kind == "ip":
        return _IP.fullmatch(text) is not None and all(len(d) <= 3 and int(d or 0) <= 255 for d in (p.lstrip("0") for p in text.split(".")))
    digits = _digits(text)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


_WIDER = {
    "email": re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+"),
    "card": re.compile(r"[0-9](?:[\x20.-]?[0-9])+"),
    "phone": re.compile(r"(?:\+|\(\+?)?[0-9][\x20().0-9/-]*[0-9]"),
}
#: Characters that a span of a kind may begin and end with.
_ENDS = {"email": re.compile(r"\w"), "ip": _DIGIT, "card": _DIGIT, "phone": re.compile(r"[0-9+(]")}


def plausible(kind: str, text: str) -> bool:
    """The check of a span that the tagger adds: wider than the base's where its pattern is narrower than the kind."""
    if kind in _WIDER and _WIDER[kind].fullmatch(text) is None:
        return False
    return kind == "email" or valid(kind, text)


def trimmed(kind: str, text: str, low: int, high: int) -> tuple[int, int]:
    """The range without characters at its ends that no span of the kind has there."""
    ends = _ENDS[kind].match
    while low < high and not ends(text, low):
        low += 1
    while low < high and not (ends(text, high - 1) and text[high - 1] not in "+("):
        high -= 1
    return low, high


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            out.append(found.span())
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches, in order."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for number, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            out += [(m.start(), number, m.end()) for m in pattern.finditer(text) if valid(KINDS[number], m.group())]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# -- the tagger's spans -----------------------------------------------------------


def _plant(rng: random.Random) -> tuple[int, str]:
    """A labelled span (kind number, text) or a look-alike (-1, text)."""

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 8)))

    kind = rng.randrange(5)
    if kind == 0:
        local = f"{word()}{rng.choice(['.', '_', '', '-'])}{rng.choice([word(), digits(2)])}"
        if rng.random() < 0.3:
            at = rng.randrange(len(local) + 1)
            local = local[:at] + rng.choice("äöüéèñßø") + local[at:]
        return 0, f"{local}@{word()}{rng.choice(['', digits(1)])}.{rng.choice(['com', 'org', 'net', 'example.com', 'co.uk', 'de'])}"
    if kind == 1:
        return 1, ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        body = rng.choice("3456") + digits(rng.choice([14, 14, 14, 13, 11, 17]))
        body += next(c for c in "0123456789" if luhn(body + c))
        gap = rng.choice(["", "", " ", "-", "."])
        return 2, gap.join(body[i : i + 4] for i in range(0, len(body), 4))
    if kind == 3:
        a, b, c = digits(3), digits(3), digits(4)
        if rng.random() < 0.2:
            return 3, "0" + rng.choice([" ", ".", "-"]).join([digits(1), *[digits(2) for _ in range(4)]])
        plus = rng.choice(["+1 ", "+44 ", "+", "", "", ""])
        return 3, plus + rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])
    look = rng.randrange(7)
    if look == 0:
        return -1, "".join(rng.choice("0123456789abcdef") for _ in range(40))
    return -1, (digits(rng.randint(1, 9)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(1)}", f"v{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"@{word()}", digits(rng.randint(20, 30)))[look]


def training_windows(texts: list[str], count: int = TRAINING_WINDOWS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Input codes and tags (0 none, 1 + 2k begins kind k, 2 + 2k goes on) of windows with labelled spans."""
    rng = random.Random(seed)
    texts = [t for t in texts if t and len(t) > WINDOW] or ["the of and in to is that for it was on as with by at from this be are an or not " * 4]
    x = np.zeros((count, WINDOW), dtype=np.uint8)
    y = np.zeros((count, WINDOW), dtype=np.int64)
    for i in range(count):
        text = rng.choice(texts)
        own = base_spans(text)
        if own and rng.random() < 0.3:
            a, _, b = rng.choice(own)
            start = max(0, min(len(text) - WINDOW, rng.randint(a - WINDOW + 4, max(a, b - 4))))
            spans = own
        else:
            kind, planted = _plant(rng)
            start = rng.randrange(len(text) - WINDOW + 1)
            cut = start + rng.randint(-len(planted) // 2, WINDOW - 4)
            cut = max(0, min(len(text), cut))
            glue = rng.choice([" ", " ", " ", "\n", ", ", ": ", " (", " tel:", " Tel. ", " call "])
            text = text[:cut] + glue + planted + rng.choice([" ", " ", ". ", ".\n", ", ", ") ", " or ", " now "]) + text[cut:]
            at = cut + len(glue)
            spans = [(a, k, b) for a, k, b in base_spans(text[max(0, start - 100) : start + WINDOW + 100])]
            spans = [(a + max(0, start - 100), k, b + max(0, start - 100)) for a, k, b in spans]
            if kind >= 0:
                spans = [s for s in spans if s[2] <= at or s[0] >= at + len(planted)] + [(at, kind, at + len(planted))]
        piece = text[start : start + WINDOW]
        x[i, : len(piece)] = codes(piece)
        for a, k, b in spans:
            for p in range(max(a, start), min(b, start + len(piece))):
                y[i, p - start] = 2 + 2 * k if p > a else 1 + 2 * k
    return x, y


def fit_tagger(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", sample: int = TRAINING_DOCUMENTS, steps: int = 800) -> Tagger:
    """A tagger trained on windows of the ``sample`` documents with the smallest hashes of the id."""
    rows = docs.select(F.substring(F.col(text_col).cast("string"), 1, TRAINING_CHARS).alias("t"), F.xxhash64(id_col).alias("h")).where("t is not null")
    ids = rows.select("h").orderBy("h").limit(sample)
    top = ids.agg(F.max("h")).collect()[0][0]
    texts = [] if top is None else [r["t"] for r in rows.where(F.col("h") <= top).orderBy("h", "t").limit(sample).collect()]
    tagger = Tagger(1 + 2 * len(KINDS))
    x, y = training_windows(texts)
    tagger.fit(x, y, steps=steps)
    return tagger


def stretches(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Ranges around digits and at signs that lie in no base span: the run of other characters they stand in, and a margin."""
    out: list[list[int]] = []
    spans = sorted((a, b) for a, _, b in base)
    k = reached = 0
    for found in _TRIGGER.finditer(text):
        at = found.start()
        while k < len(spans) and spans[k][0] <= at:
            reached = max(reached, spans[k][1])
            k += 1
        if at < reached:
            continue
        if out and at < out[-1][1] - MARGIN:
            continue
        low, high = at, at + 1
        while low > 0 and at - low < _REACH and not text[low - 1].isspace():
            low -= 1
        while high < len(text) and high - at < _REACH and not text[high].isspace():
            high += 1
        low, high = max(0, low - MARGIN), min(len(text), high + MARGIN)
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def added_spans(tagger: Tagger, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of each text that its base does not have."""
    parts, windows, place = [], [], []
    for i, (text, base) in enumerate(zip(texts, bases)):
        for low, high in stretches(text, base):
            code = codes(text[low:high])
            part = len(parts)
            parts.append((i, low, high))
            for start in range(0, max(1, len(code) - WINDOW + STRIDE), STRIDE):
                row = np.zeros(WINDOW, dtype=np.uint8)
                piece = code[start : start + WINDOW]
                row[: len(piece)] = piece
                windows.append(row)
                place.append((part, start, len(piece)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not parts:
        return out
    totals = [np.zeros((high - low, tagger.tags)) for _, low, high in parts]
    counts = [np.zeros((high - low, 1)) for _, low, high in parts]
    for a in range(0, len(windows), 2048):
        scores = tagger.emissions(np.stack(windows[a : a + 2048]))
        for score, (part, start, size) in zip(scores, place[a : a + 2048]):
            totals[part][start : start + size] += score[:size]
            counts[part][start : start + size] += 1
    for (i, low, _), (path, sure) in zip(parts, tagger.decode([t / c for t, c in zip(totals, counts)])):
        if not path.any():
            continue
        begins = np.flatnonzero(path % 2 == 1)
        for a in begins.tolist():
            kind, b = int(path[a] - 1) // 2, a + 1
            while b < len(path) and path[b] == 2 + 2 * kind:
                b += 1
            name = KINDS[kind]
            x, y = trimmed(name, texts[i], low + a, low + b)
            if x < y and sure[x - low : y - low].min() >= CONFIDENCE and plausible(name, texts[i][x:y]) and _whole(name, texts[i], x, y):
                if all(y <= p or x >= q for p, _, q in bases[i] + out[i]):
                    out[i].append((x, kind, y))
    return out


def _whole(kind: str, text: str, low: int, high: int) -> bool:
    """No part of a longer word or number; a phone has separators."""
    before, after = text[low - 1 : low], text[high : high + 1]
    if before.isalnum() or after.isalnum() or not text[low:high].strip() == text[low:high]:
        return False
    if before in ("-", ".", "/", "@", "_") or (before == ":" and kind != "phone") or (after in ("-", "/", ":") and text[high + 1 : high + 2].isalnum()) or (after == "." and text[high + 1 : high + 2].isdigit()):
        return False
    return kind != "phone" or sum(c in " -.()" for c in text[low:high]) >= 2


def find(docs: DataFrame, tagger: Tagger | None, *, text_col: str = "text") -> DataFrame:
    """All rows and columns with ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and ``base_sha256`` of the base, and ``spans`` of both."""
    fields = [(f"n_{k}", T.LongType()) for k in KINDS] + [("base_sha256", T.StringType()), ("spans", T.StringType())]

    def make():
        def run(texts):
            texts = [t or "" for t in texts]
            bases = [base_spans(t) for t in texts]
            more = added_spans(tagger, texts, bases) if tagger else [[] for _ in texts]
            cols: list[list] = [[sum(k == n for _, k, _ in b) for b in bases] for n in range(len(KINDS))]
            cols.append([hashlib.sha256(joined(b).encode()).hexdigest() for b in bases])
            cols.append([joined(sorted(b + m)) for b, m in zip(bases, more)])
            return cols

        return run

    return append_columns(docs, text_col, fields, make)


def redact(docs: DataFrame, tagger: Tagger | None, *, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with each span's text replaced by its kind in brackets; ``n_chars`` is set anew."""
    names = docs.columns

    def make():
        def run(texts):
            plain = [t or "" for t in texts]
            bases = [base_spans(t) for t in plain]
            more = added_spans(tagger, plain, bases) if tagger else [[] for _ in texts]
            out = []
            for original, text, spans in zip(texts, plain, map(list.__add__, bases, more)):
                kept, at = [], 0
                for a, kind, b in sorted(spans):
                    if a >= at:
                        kept.append(text[at:a] + f"[{KINDS[kind].upper()}]")
                    at = max(at, b)
                out.append(original if original is None else "".join([*kept, text[at:]]))
            return [out]

        return run

    fresh = "redacted"
    while fresh in names:
        fresh += "_"
    out = append_columns(docs, text_col, [(fresh, T.StringType())], make).drop(text_col).withColumnRenamed(fresh, text_col)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def op8_personal_data(spark, sf_dir):
    """Contract query: base counts and digest of each document, and all its spans."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return find(docs, fit_tagger(docs)).drop("text")
