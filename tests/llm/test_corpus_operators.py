"""Each corpus operator against a brute-force version, over odd rows: nulls, empty and long texts, copies, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.llm import bpe, langid, merkle, nearcopies, packing, pii, quality, simhash, suffix, tokens, toxicity
from spanforge.llm.components import connected_components
from spanforge.llm.tagger import Tagger

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, uid string, body string, n_words string, h int, spans int"


def _texts(seed=1, n=40):
    rng = random.Random(seed)
    words = ["the", "and", "Über", "naïve", "x1", "of", "in", "to", "日本", "ein", "42", "a.b@c.de", "+1 (848) 555-1373", "10.0.0.1"]
    out = [None, "", " \n\t", "short", "é" * 500, "7" * 900]
    base = " ".join(rng.choice(words) + rng.choice(["", ".", ","]) for _ in range(160))
    out += [base, base, base + " tail", "head " + base, base[:700] + "Q" + base[701:]]
    while len(out) < n:
        out.append(" ".join(rng.choice(words) + rng.choice(["", ".", ",", "\n"]) for _ in range(rng.randint(1, 200))))
    out.append(" ".join(rng.choice(words) for _ in range(30_000)))
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A stored table with null and repeated ids and columns that clash with the operators' own."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, ["en", "fr", None][k % 3], "s", None if t is None else len(t), 0.5, "z", "u", "b", "w", 1, 2) for k, (i, t) in enumerate(zip(ids, texts))]
        path = str(tmp_path_factory.mktemp("docs") / "d")
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="module")
def odd(stored):
    return stored(_texts())


def _by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# -- tokens, packing, BPE ---------------------------------------------------------------


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab éß日😀1'st.,! \n\t\x1c\x85 ", max_size=30))
def test_units_encode_as_the_library(text):
    ids = np.frombuffer(tokens.encoder().encode(text), "<u4").tolist()
    assert ids == _library().encode(text, add_special_tokens=False).ids


def test_special_strings_and_memo_limits():
    small = tokens.UnitEncoder(memo=2)
    for text in ("a <|endoftext|> b", "one two three four one", " lead", "trail ", "a\n\nb"):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == _library().encode(text, add_special_tokens=False).ids


def test_token_counts(spark, odd, tmp_path):
    library = _library()
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect()}
    order = tokens.write_token_files(odd, str(tmp_path / "t"), docs_per_file=3)
    for size in (2, 64, 1 << 20):
        found = tokens.scan_token_files(spark, str(tmp_path / "t"), block_bytes=size, docs_per_file=3)
        got = order.join(found, ["file_no", "document"], "full")
        assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == want


def test_the_separator_as_text_is_ordinary_text(spark, stored, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain", None]
    plain = tokens.UnitEncoder().ids
    order = tokens.write_token_files(stored(texts), str(tmp_path / "t"))
    got = order.join(tokens.scan_token_files(spark, str(tmp_path / "t")), ["file_no", "document"], "full")
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {k: len(plain(t or "")) for k, t in enumerate(texts)}


def test_open_tail_is_reported(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(np.array([1, 2, 50256, 50256, 3, 4, 5], "<u2").tobytes())
    got = tokens.scan_token_files(spark, str(tmp_path / "x.bin"), block_bytes=4).orderBy("document").collect()
    assert [(r["n_tokens"], r["closed"]) for r in got] == [(2, True), (0, True), (3, False)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=80))
def test_packing_fits_and_has_no_gaps(sizes):
    lengths = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    sequence, offset, used = packing.sum_of_squares(lengths, 64)
    filled = collections.defaultdict(int)
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist())):
        assert filled[s] == o and o + n <= 64
        filled[s] += n
    assert len(filled) == used <= max(1, math.ceil(sum(sizes) / 64) * 1.5 + 1)


def _check_packing(df, docs):
    library = _library()
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    rows = sorted(df.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    end, seen = {}, collections.defaultdict(list)
    for r in rows:
        assert end.get(r["sequence_id"], 0) == r["offset"]
        end[r["sequence_id"]] = r["offset"] + r["length"]
        assert end[r["sequence_id"]] <= 1024
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for i, own in ids.items():
        parts = sorted(seen[i])
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for _, _, n in parts) == len(own)
        assert all(n == 1024 for _, _, n in parts[1:])
    return len(end), sum(map(len, ids.values()))


def test_packing(odd):
    pieces = packing.materialise(packing.tokenised_pieces(odd), "pieces")
    used, total = _check_packing(packing.pack(pieces), odd)
    assert used <= math.ceil(total / 1024) + 2
    _check_packing(packing.pack(pieces, shard_pieces=7), odd)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeth ing\n ÉèüßA日本語😀123'st.,!-", max_size=40))
def test_transducer_encodes_as_the_public_library(text):
    import public_tokenizers
    import tiktoken

    codec = bpe.codec()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    packed = codec.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == own.encode_ordinary(text)
    assert "".join(codec.decode(packed, portion=3)) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=24))
def test_transducer_is_the_merge_order(piece):
    codec = bpe.codec()
    assert codec.transducer.encode(piece) == bpe.merge_bytes(piece, codec.ranks)


def test_long_pieces_settle_early():
    codec = bpe.codec()
    rng = random.Random(4)
    long = "".join(rng.choice("ethianors") for _ in range(9000)).encode()
    whole = codec.transducer.encode(long)
    codec.transducer.span, kept = 64, codec.transducer.span
    try:
        assert codec.transducer.encode(long) == whole
        assert codec.transducer.encode(b"a" * 3000) == bpe.merge_bytes(b"a" * 3000, codec.ranks)
    finally:
        codec.transducer.span = kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40_000), max_size=12), st.integers(1, 5))
def test_decoding_streams_tokens_that_end_inside_characters(ids, portion):
    codec = bpe.codec()
    whole = b"".join(codec.pieces[i] for i in ids)
    assert "".join(codec.decode(np.array(ids, "<u4").tobytes(), portion)) == whole.decode("utf-8", "replace")


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.lists(st.integers(0, 30), max_size=4))
def test_streaming_utf8(data, cuts):
    stream, out, at = bpe.Utf8Decoder(), "", 0
    for cut in sorted(cuts) + [len(data)]:
        out += stream.feed(data[at:cut])
        at = max(at, cut)
    assert out + stream.close() == data.decode("utf-8", "replace")


def test_codec_columns(odd):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec().ranks, special_tokens={})
    got = _by_id(bpe.digests(odd), "n_tokens", "ids_sha256", "decoded_sha256", "text")
    for n, ids, digest, text in got.values():
        want = library.encode_ordinary(text or "")
        assert n == len(want) and ids == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert digest == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode_column(bpe.encode_column(odd))
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())


# -- copies -----------------------------------------------------------------------------


def _brute_repeats(texts, window, first_stays=False):
    seen = collections.Counter(t[s : s + window] for t in texts for s in range(len(t) - window + 1))
    had, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - window + 1):
            string = t[s : s + window]
            if seen[string] > 1 and (not first_stays or string in had):
                gone[s : s + window] = True
            had.add(string)
        runs = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def _spans(docs, **how):
    keyed = suffix.keyed_texts(docs)
    found = {r["uid"]: r for r in suffix.repeated_spans(keyed, **how).collect()}
    out = {}
    for r in keyed.collect():
        f = found.get(r["uid"])
        kept, runs = suffix.cut_spans(bytes(r["body"]), f and f["whole"], f and f["spans"])
        out.setdefault(r["row"]["doc_id"], []).append((len(r["body"]), len(r["body"]) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("crowded", [20_000, 1])
def test_repeats(stored, crowded):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = _texts(2, 20) + [passage[a : a + n] + str(k) * 9 + passage[200 : 200 + n // 2] for k, (a, n) in enumerate([(0, 500), (100, 460), (37, 800), (0, 399), (499, 401)] * 3)]
    texts += ["ab" * 600, "ab" * 300 + "c", passage + passage]
    ids = [None if k == 0 else k // 2 for k in range(len(texts))]
    want = collections.defaultdict(list)
    for i, row in zip(ids, _brute_repeats([(t or "").encode() for t in texts], 400)):
        want[i].append(row)
    assert _spans(stored(texts, ids), crowded=crowded) == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("crowded", [20_000, 1])
def test_first_places_stay(stored, crowded):
    rng = random.Random(10)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(600))
    texts = _texts(3, 14) + [passage[a : a + n] + str(k) * 9 + passage[100 : 100 + n // 2] for k, (a, n) in enumerate([(0, 300), (60, 260), (37, 500), (0, 179), (299, 181)] * 3)]
    texts += ["ab" * 300, "ab" * 150 + "c", passage + passage, "x" + passage, passage]
    docs = stored(texts)
    placed = [r["doc_id"] for r in suffix.keyed_texts(docs).orderBy("uid").select("row.doc_id").collect()]
    want = dict(zip(placed, _brute_repeats([(texts[i] or "").encode() for i in placed], 180, True)))
    assert _spans(docs, window=180, crowded=crowded, first_stays=True) == {k: [v] for k, v in want.items()}


def test_passages_of_over_50_words(spark, tmp_path):
    """Passages of 51 to 70 words, most of under 400 bytes, show in a column of their own; what is removed stays the contract's."""
    rng = random.Random(12)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))

    passages = [words(n) for n in range(51, 71)]
    planted = [f"{words(30)} {passages[k % 20]} {words(30)}" for k in range(40)]
    texts = planted + [words(120) for _ in range(10)] + [None, "", passages[3]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in suffix.op2_suffix_array_dedup(spark, str(tmp_path)).collect()}
    bodies = [(t or "").encode() for t in texts]
    assert {i: tuple(r)[1:5] for i, r in out.items()} == dict(enumerate(_brute_repeats(bodies, 400)))
    assert {i: r["n_passage_bytes"] for i, r in out.items()} == {i: row[1] for i, row in enumerate(_brute_repeats(bodies, 180))}
    assert {i for i, r in out.items() if r["n_passage_bytes"]} == {*range(40), len(texts) - 1}
    assert any(not out[i]["n_removed"] for i in range(40))


def test_passages_are_counted_by_words(spark, tmp_path):
    """50 words or a few long ones are no passage; 51 are, also as a whole text, twice in one text or beside another."""
    rng = random.Random(14)

    def words(n, least=3):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(least, least + 4))) for _ in range(n))

    few, long, one, two, copy, short = words(50), words(20, 12), words(51), words(51), words(60), words(40, 5)
    texts = [f"0 {few} 1", f"2 {few} 3", f"4 {long} 5", f"6 {long} 7", f"8 {one} 9 {two} A", f"B {one} C", f"D {two} E {two} F", copy, copy, short, short, words(90), None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in suffix.op2_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert [out[i]["n_passages"] for i in range(len(texts))] == [0, 0, 0, 0, 2, 1, 2, 1, 1, 0, 0, 0, 0, 0]
    assert [i for i in range(len(texts)) if not out[i]["n_passage_bytes"]] == [11, 12, 13]


@pytest.mark.parametrize("crowded", [20_000, 1])
def test_nested_lengths(stored, crowded):
    """Long strings are found within the runs of short ones: runs that only short strings make up, copies, copies of parts of copies, single texts."""
    rng = random.Random(13)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(250)) for _ in range(6)]
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = _texts(4, 12) + [parts[k] + parts[(k + 1) % 6] + str(k) for k in range(6)] + parts[:2] * 2
    texts += [passage, passage, "x" + passage[100:560] + "y", passage[600:] + passage[:399], "ab" * 500, "c" + parts[0] * 2, passage[:181] + "z" + passage[300:480]]
    docs = stored(texts)
    keyed = suffix.keyed_texts(docs)
    found = {r["uid"]: r for r in suffix.nested_spans(keyed, crowded=crowded).collect()}
    for window, name in [(180, "spans"), (400, "wide")]:
        placed = keyed.orderBy("uid").collect()
        want = _brute_repeats([bytes(r["body"]) for r in placed], window)
        for r, row in zip(placed, want):
            f, body = found.get(r["uid"]), bytes(r["body"])
            kept, runs = suffix.cut_spans(body, f and f["whole"] and len(body) >= window, f and f[name])
            assert (len(body), len(body) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()) == row


def test_repeats_keep_characters_whole(stored):
    docs = stored(["é" * 400 + "a", "b" + "é" * 400, None])
    kept = _by_id(suffix.remove_repeats(docs), "text", "n_chars")
    assert kept == {0: ("a", 1), 1: ("b", 1), 2: (None, None)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: b"x" * 40 + bytes(97 + c % 3 for c in b)), max_size=20))
def test_deep_shallow_order(strings):
    order = suffix.deep_shallow_order(strings)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))


def _brute_fp(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_as_defined(odd):
    got = _by_id(simhash.fingerprints(odd, out="fp"), "fp", "text")
    assert all(f & (1 << 64) - 1 == _brute_fp(t) for f, t in got.values())


def _close(values, radius):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_bit_sliced_pairs(radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for c in centres for _ in range(30)})
    i, j = simhash.close_pairs(np.array(values, dtype=np.uint64), np.array([0, len(values)]), radius)
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if (values[a] ^ values[b]).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_files_of_the_last_level_are_bounded():
    left = [64 - simhash._union(path).bit_count() for path in simhash._masks(simhash.RADIUS, simhash.LEVELS)[-1]]
    assert 1 << max(left) <= simhash.CROWDED


@pytest.mark.parametrize("crowded", [20_000, 2])
def test_components_of_fingerprints(spark, crowded):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(8)]
    values = [0, 0, 1, 7] + [c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(12)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(None if k == 1 else k, v) for k, v in enumerate(signed)], "doc_id long, fp long")
    roots = _close(sorted(set(values)), 2)
    first = {}
    for k, v in enumerate(values):
        if k != 1:
            first[roots[v]] = min(first.get(roots[v], k), k)
    links = simhash.links(rows.select("fp").distinct(), crowded=crowded)
    labels = {r["node"]: r["root"] for r in connected_components(links).collect()}
    named = collections.defaultdict(list)
    for k, v in enumerate(signed):
        named[labels.get(v, v)].append(k)
    want = collections.defaultdict(list)
    for k, v in enumerate(values):
        want[roots[v]].append(k)
    assert sorted(named.values()) == sorted(want.values())
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(rows).collect()]
    assert sorted(got, key=repr) == sorted([(None if k == 1 else k, first[roots[v]]) for k, v in enumerate(values)], key=repr)


def test_one_of_each_group_stays(stored):
    texts = _texts(3, 12)
    docs = stored(texts, [5, 5, 5, 4, 4, 3, 9, 8, 7, None, 2, 1, 0])
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns
    assert docs.where(F.col("text") == texts[6]).count() == 2 and kept.where(F.col("text") == texts[6]).count() <= 1
    assert kept.where("text is null or trim(text) = ''").count() == 1


def _alike(a, b):
    both = len(np.intersect1d(a, b))
    return 5 * both >= 4 * (len(a) + len(b) - both)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=50), min_size=2, max_size=9))
def test_shared_counts(sets):
    arrays = [np.array(sorted(x), dtype=np.uint64) for x in sets]
    i, j = np.triu_indices(len(arrays), 1)
    want = [len(sets[a] & sets[b]) for a, b in zip(i, j)]
    assert nearcopies.shared_counts(arrays, i, j).tolist() == want
    assert nearcopies.shared_counts(arrays, np.tile(i, 20), np.tile(j, 20)).tolist() == want * 20


@pytest.mark.parametrize("run", [256, 8])
def test_large_groups_are_dealt_into_runs(spark, stored, monkeypatch, run):
    """A group of copies that differ from one original, most pairs of them below the likeness, in runs smaller than the group."""
    monkeypatch.setattr(nearcopies, "RUN", run)
    rng = random.Random(12)
    original = [f"w{rng.randrange(9999)}" for _ in range(150)]
    texts = [" ".join(original)]
    for _ in range(60):
        copy = list(original)
        for at in rng.sample(range(150), rng.randint(1, 6)):
            copy[at] = f"c{rng.randrange(9999)}"
        texts.append(" ".join(copy))
    sets = [nearcopies.shingles(t.encode()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _alike(sets[i], sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    kept = nearcopies.keep_one(stored(texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_near_dedup_stage_is_by_likeness(spark, stored):
    """The stage's kept rows against all pairs' exact likeness of five-word shingles, among them a chain and near misses."""
    import corpus_pipeline

    rng = random.Random(5)
    texts = [None, "", "a b", "A  b", "a c"]
    for _ in range(12):
        words = [f"w{rng.randrange(9999)}" for _ in range(200)]
        texts.append(" ".join(words))
        for changed in (1, 2, 3, 4, 5, 6, 8):
            copy = list(words)
            for at in rng.sample(range(200), changed):
                copy[at] = "changed"
            texts.append(" ".join(copy))
        for end in range(8, 64, 8):
            texts.append(" ".join(words[end:] + [f"t{k}" for k in range(end)]))

    def parts(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [parts(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    docs = stored(texts)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_chain_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100), (200, None)], "a long, b long")
    assert {r["root"] for r in connected_components(links).collect()} == {0}


# -- quality, language, toxicity, personal data ----------------------------------------------


def _brute_quality(text):
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = word.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if word.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_measures(stored):
    docs = stored(_texts(4, 25) + ["a\nb\na\n \n \nb", "#x| <y>\n#x| <y>", "x\x0by\x0cz \x1c"])
    got = _by_id(quality.base_measures(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text")
    assert all(v[:5] == _brute_quality(v[5]) for v in got.values())


def test_exact_bound():
    def below(bad, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(bad + 1))

    for bad, n, delta in ((0, 100, 0.05), (3, 50, 0.01), (7, 400, 0.001)):
        assert below(bad, n, quality.upper_bound(bad, n, delta)) == pytest.approx(delta, rel=1e-6)
    assert quality.upper_bound(0, 0, 0.05) == 1.0 and quality.upper_bound(5, 5, 0.05) == 1.0


def test_cutoffs_are_certified_and_few_labels_reject_nothing():
    grid = quality.RULES["symbols"]
    many = {("en", "symbols"): (100_000, [0] * 10 + [5_000] * (len(grid) - 10))}
    assert quality.certify(many) == {("en", "symbols"): grid[9]}
    assert quality.certify({("en", "symbols"): (50, [0] * len(grid))}) == {}


def test_few_labels_certify_the_whole_rule_set():
    last = len(quality.PATH)
    found = quality.certify_path({"es": {last: 307}, "xx": {last: 50}, "fr": {20: 300, last: 100}})
    assert {s for s, _ in found} == {"es", "fr"}
    assert {r: c for (s, r), c in found.items() if s == "es"} == {r: g[-1] for r, g in quality.RULES.items()}
    assert {r: c for (s, r), c in found.items() if s == "fr"} == dict(quality.PATH[:20])


def test_quality_verdicts(spark, stored):
    docs = stored([" ".join(f"w{k}x{i}" for i in range(60)) for k in range(30)] + [None, "few words"])
    measured = quality.base_measures(docs)
    labels = spark.createDataFrame([(k, 1) for k in range(30)] + [(None, 1), (3, None), (99, 1)], "doc_id long, quality int")
    counts = quality.holdout_counts(measured, labels)
    assert {n for n, _ in counts.values()} == {10}
    out = _by_id(quality.apply_cutoffs(measured, {("en", "long_words"): 1.0}), "base_failed", "kept", "failed_rule")
    assert out[0] == (False, False, "long_words") and out[1] == (False, True, None) and out[30] == (True, False, None)


def test_language(spark, stored):
    rng = random.Random(6)
    kinds = {"en": ["the", "thing", "with", "of"], "fr": ["être", "deux", "que", "ç"]}
    texts = [" ".join(rng.choice(kinds[["en", "fr"][k % 3 % 2]]) for _ in range(40)) for k in range(30)] + [None, "", "123 !!"]
    docs = stored(texts)
    profiles = langid.fit_profiles(docs, F.col("doc_id") < 24)
    got = _by_id(langid.identify(docs, profiles), "lang_pred", "score")
    assert all(got[k] == ("und", 0.0) for k in (30, 31, 32))
    assert profiles.names == ["en", "fr"] and got[1][0] in profiles.names and 0 <= got[1][1] <= 1
    empty = langid.fit_profiles(docs.limit(0))
    assert _by_id(langid.identify(docs, empty), "lang_pred")[0] == ("und",)


def test_language_stage_without_any_language(spark, stored):
    import corpus_pipeline

    docs = stored(["clean text", "12 34", "", None, "日本"]).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 4]


def test_language_distance_by_hand():
    def grams(text):
        s = re.sub(r"[^a-z]+", "_", f"_{text.lower()}_")
        return collections.Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n] != "_")

    def ranked(text):
        code = {g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)) for g in grams(text)}
        return sorted(grams(text), key=lambda g: (-grams(text)[g], code[g]))[:20], code

    profiles = {}
    for name, text in (("x", "banana bandana"), ("y", "cherry merry")):
        order, code = ranked(text)
        profiles[name] = [code[g] for g in order]
    own, code = ranked("a band of cherries")
    want = [sum(abs(k - p.index(code[g])) if code[g] in p else 20 for k, g in enumerate(own)) for p in profiles.values()]
    assert langid.Profiles(profiles, 20).distances("a band of cherries").tolist() == want


def _toxic_index(rng, n=300):
    names = [f"stem{i:02d}" for i in range(40)]
    examples = []
    for _ in range(n):
        found = sorted(rng.sample(range(40), rng.randint(0, 6)))
        examples.append((found, [rng.randint(1, 9) for _ in found], rng.choice([0, 1, 50, 400])))
    return toxicity.Index(names, examples, [int(rng.random() < 0.3) for _ in examples], (3.0, 1.0)), examples


def _dense(index, example):
    vector = np.zeros(41)
    found, counts, rest = example
    for t, c in zip(found, counts):
        vector[t] = 1 + math.log(c)
    vector[40] = math.sqrt(rest) / 2
    vector *= index.idf
    size = np.linalg.norm(vector)
    return vector / size if size else vector


def test_block_max_search_is_exact():
    rng = random.Random(8)
    index, examples = _toxic_index(rng, 1500)
    unit = np.array([_dense(index, e) for e in examples])
    for k in range(60):
        found = sorted(rng.sample(range(40), rng.randint(0, 5)))
        query = examples[k] if k < 10 else (found, [rng.randint(1, 9) for _ in found], rng.randint(1, 300))
        cos = np.round(unit @ _dense(index, query), 12)
        if k < 10:
            cos[k] = 0
        who, how = index.nearest(*index.vector(*query), 8, skip=k if k < 10 else -1)
        least = np.sort(cos)[-8] if (cos > 0).sum() >= 8 else 1e-12
        assert set(who.tolist()) == set(np.flatnonzero((cos >= least) & (cos > 0)).tolist())
        assert np.allclose(how, cos[who], atol=1e-11)


def test_scores_against_brute_force():
    """Votes of all neighbours over dense vectors, calibrated by a curve that the likelihood's slope confirms."""
    rng = random.Random(18)
    index, examples = _toxic_index(rng)
    unit = np.array([_dense(index, e) for e in examples])
    y, w = index.labels, index.votes
    share = (y * w).sum() / w.sum()

    def vote(cos):
        least = np.sort(cos)[-8]
        v = np.where((cos >= least) & (cos > 0), w * cos**2, 0)
        return ((v * y).sum() + 0.1 * share) / (v.sum() + 0.1)

    every = np.round(unit @ unit.T, 12)
    np.fill_diagonal(every, 0)
    left = np.clip([vote(c) for c in every], 1e-4, 1 - 1e-4)
    x, (a, b) = np.log(left / (1 - left)), index.curve
    p = 1 / (1 + np.exp(-(a * x + b)))
    assert abs((w * (p - y) * x).sum() + 0.01 * (a - 1)) < 1e-5 and abs((w * (p - y)).sum() + 0.01 * b) < 1e-5
    for text, query in (("xx yy", ([], [], 2)), ("stem03", ([3], [1], 0)), ("stem01 stem01 stem07 plain", ([1, 7], [2, 1], 1))):
        index.vocabulary.number = {f"stem{i:02d}$": i for i in range(40)}
        index.vocabulary.clear()
        v = min(max(vote(np.round(unit @ _dense(index, query), 12)), 1e-4), 1 - 1e-4)
        assert index.score(text)[0] == pytest.approx(1 / (1 + math.exp(-(a * math.log(v / (1 - v)) + b))), abs=1e-9)
    assert index.score(None) == index.score(" .") == (pytest.approx(share), [])


def test_toxicity(spark, stored):
    rng = random.Random(7)
    plain = [f"word{i}" for i in range(200)]
    texts = [" ".join(rng.sample(plain, 40) + (["vileword"] * 3 if k % 4 == 0 else [])) for k in range(200)] + [None, ""]
    docs = stored(texts)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    index = toxicity.fit_index(docs, labels, F.col("doc_id") % 3 != 1)
    got = _by_id(toxicity.score_texts(docs, index), "score", "evidence")
    toxic, clean = [got[k][0] for k in range(0, 200, 4)], [got[k][0] for k in range(200) if k % 4]
    assert min(toxic) >= 0.7 and max(clean) < 0.3 and got[200][0] == got[201][0] < 0.3
    assert all(i % 4 == 0 for i in got[4][1][:1])
    none = toxicity.fit_index(docs, labels.limit(0))
    assert _by_id(toxicity.score_texts(docs, none), "score")[0] == (0.0,)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    text_ids = toxicity.fit_index(named, labels.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))))
    assert toxicity.score_texts(named, text_ids).where("doc_id = 'd4'").first()["evidence"][0].startswith("d")


def test_calibration_on_held_out_rows(spark):
    """Reliability at sf0.1: in each range of scores the share of toxic held-out documents is near the mean score."""
    base = "/root/testdata/sf0.1"
    got = toxicity.op3_toxicity(spark, base).where("held_out")
    marks = spark.read.parquet(f"{base}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("y")).where("y is not null")
    rows = [(r["score"], r["y"], r["predicted"]) for r in got.join(marks, "doc_id").collect()]
    brier = np.mean([(s - y) ** 2 for s, y, _ in rows])
    low, high = [y for s, y, _ in rows if s < 0.05], [y for s, y, _ in rows if s >= 0.8]
    assert brier < 0.015 and np.mean(low) < 0.02 and np.mean(high) > 0.95
    assert np.mean([p for _, y, p in rows if y]) > 0.9 and np.mean([p for _, y, p in rows if not y]) < 0.005


PATTERNS = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab1234567890 .-+@()é", max_size=60))
def test_base_spans(text):
    def good(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == 1:
            return all(int(p) <= 255 for p in found.split("."))
        return kind == 0 or (12 <= len(digits) <= 19 and pii.luhn(digits) if kind == 2 else 9 <= len(digits) <= 15)

    want = sorted((m.start(), k, m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good(k, m.group()))
    assert pii.base_spans(text) == want


def test_tagger_gradients():
    tagger = Tagger(3, hidden=3, embed=4)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 20, (2, 5)).astype(np.uint8), rng.integers(0, 3, (2, 5))
    grads, _ = tagger._gradients(x, y)
    for name in ("V", "T", "Wf", "Wb", "E", "bf"):
        at = np.unravel_index(int(np.abs(grads[name]).argmax()), grads[name].shape)
        kept = tagger.p[name][at]
        ends = []
        for step in (1e-4, -1e-4):
            tagger.p[name][at] = kept + step
            ends.append(tagger._gradients(x, y)[1])
        tagger.p[name][at] = kept
        assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=2e-2, abs=1e-4)


def test_decoding_is_the_best_path_and_its_posterior():
    import itertools

    tagger = Tagger(3, hidden=2, embed=2)
    rng = np.random.default_rng(3)
    tagger.p["T"] = rng.standard_normal((3, 3)).astype(np.float32)
    trans = tagger.p["T"].astype(np.float64)
    scores = [rng.standard_normal((n, 3)) * 2 for n in (1, 4, 2, 5)]
    for e, (path, sure) in zip(scores, tagger.decode(scores)):
        paths = list(itertools.product(range(3), repeat=len(e)))
        weight = np.array([sum(e[t, p[t]] for t in range(len(e))) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert tuple(path) == paths[int(weight.argmax())]
        share = np.exp(weight - weight.max())
        share /= share.sum()
        want = [sum(s for p, s in zip(paths, share) if p[t] == path[t]) for t in range(len(e))]
        assert np.allclose(sure, want, atol=1e-9)


def test_long_zero_runs_and_added_forms():
    text = "0" * 5000 + ".1.1.1"
    assert pii.base_spans(text) == [(0, 1, len(text))]
    assert pii.base_spans("1.1.1." + "9" * 5000) == []
    assert not pii.plausible("phone", "06 12 34 56 78 ok") and pii.plausible("phone", "06 12 34 56 78")
    assert pii.plausible("email", "jürgen@straße.de") and not pii.plausible("email", "a b@c.de") and not pii.plausible("card", "1234.5678.9012")
    assert pii.trimmed("phone", "x (848) 555-1373. y", 1, 18) == (2, 16)
    # a stretch holds the whole run of other characters
    long = "a" * 40 + "@" + "b" * 40 + ".de"
    assert pii.stretches("x " * 30 + long + " y" * 30, [])[0][0] <= 60 - pii.MARGIN and pii.stretches("no digit", []) == []


@pytest.fixture(scope="module")
def tagger(spark):
    """As the query trains it, from the documents of sf0.01."""
    return pii.fit_tagger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_tagger_on_held_out_plants(spark, tagger):
    """Spans planted in documents that were not trained on: what the base lacks is found, and nothing else."""
    rng = random.Random(99)
    texts = [r["text"][:400] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 97 = 5 and text is not null").orderBy("doc_id").collect()]
    lacking, found, wrong = collections.Counter(), collections.Counter(), 0
    made, truth = [], []
    for _ in range(900):
        text, (kind, planted) = rng.choice(texts), pii._plant(rng)
        cut = rng.randrange(len(text) + 1)
        while cut < len(text) and not text[cut].isspace():
            cut += 1
        made.append(text[:cut] + rng.choice([" ", ", ", ": "]) + planted + rng.choice([" ", ". ", ", "]) + text[cut:])
        at = made[-1].index(planted, cut)
        truth.append((at, kind, at + len(planted)))
    bases = [pii.base_spans(t) for t in made]
    for span, base, added in zip(truth, bases, pii.added_spans(tagger, made, bases)):
        if span[1] >= 0 and not any(a < span[2] and b > span[0] for a, _, b in base):
            lacking[span[1]] += 1
            found[span[1]] += span in added
        wrong += sum(s != span for s in added)
    assert lacking[3] > 50 and found[3] >= 0.8 * lacking[3] and found[2] >= 0.5 * lacking[2]
    assert wrong <= 0.02 * sum(found.values())


def test_personal_data(odd, tagger):
    x, y = pii.training_windows([t for t in _texts(5) if t], 200, seed=77)
    right = np.mean([(p == t).mean() for (p, _), t in zip(tagger.decode(list(tagger.emissions(x))), y)])
    assert right > 0.85
    rows = pii.find(odd, tagger).collect()
    for r in rows:
        base = pii.base_spans(r["text"])
        assert set(filter(None, pii.joined(base).split(","))) <= set(r["spans"].split(","))
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert r["n_email"] == sum(k == 0 for _, k, _ in base)
    redacted = _by_id(pii.redact(odd, tagger), "text")
    for r in rows:
        kept, at = "", 0
        for span in filter(None, r["spans"].split(",")):
            kind, low, high = span.split(":")
            if int(low) >= at:
                kept += (r["text"] or "")[at : int(low)] + f"[{kind.upper()}]"
            at = max(at, int(high))
        assert redacted[r["doc_id"]] == (None if r["text"] is None else kept + r["text"][at:],)
    assert pii.redact(odd, tagger).columns == odd.columns


# -- Merkle fingerprints --------------------------------------------------------------------


def _print(text):
    leaf = [hashlib.sha256(p.encode()).hexdigest()[:16] for p in re.findall(r"[^\n.!?]*[\n.!?]+|[^\n.!?]+", text)]
    section = "".join(hashlib.sha256("".join(leaf[i : i + 8]).encode()).hexdigest()[:16] for i in range(0, len(leaf), 8))
    return ":".join([hashlib.sha256(section.encode()).hexdigest()[:32], section, "".join(leaf)]), set(leaf)


def test_merkle(spark, stored, tmp_path):
    ids = [5, 2000, None, 10**12, 7, 1024, 1023, 6, 8, 9, 3_000_000, 11]
    texts = [t for t in _texts(6, 11)]
    base = tmp_path / "documents.parquet"
    stored(texts, ids).write.parquet(str(base))
    rows = sorted(zip(ids, [t or "" for t in texts]), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        (own, a), (other, b), (_, c) = _print(text), _print(edited), _print(after)

        def like(x, y):
            return len(x & y) / len(x | y) if x | y else 1.0

        want[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, like(a, b), like(a, c))
    got = _by_id(merkle.op9_fingerprints(spark, str(tmp_path)), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert got == want


@pytest.mark.parametrize("per_range", [4096, 3, 1])
def test_successors_of_sparse_and_repeated_ids(spark, per_range):
    rng = random.Random(per_range)
    ids = [-(2**63), -(2**62), 0, 1, 2, *[k << 40 for k in range(1, 40)], 2**63 - 1, *[77] * 30]
    rows = [(i, f"t{k}", k, "x") for k, i in enumerate(rng.sample(ids, len(ids)))]
    docs = spark.createDataFrame(rows, "key long, text string, _range int, next string").repartition(3)
    got = merkle.with_successor(docs, "key", ["text"], rows_per_range=per_range)
    assert got.columns == ["key", "text", "_range", "next"]
    found = {r["text"]: r["next"]["text"] for r in got.collect()}
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = [t for _, _, t in sorted((i, hashes[t], t) for i, t, _, _ in rows)]
    assert found == dict(zip(order, order[1:] + order[:1]))
    one = merkle.with_successor(docs.where("key = 0"), "key", ["text"], rows_per_range=per_range).first()
    assert one["next"]["text"] == one["text"]
    assert merkle.with_successor(docs.limit(0), "key", ["text"]).collect() == []


def test_ranges_stay_even_for_sparse_ids(spark):
    keys = spark.range(20_000).select((F.col("id") * (1 << 30)).alias("_key"), F.xxhash64("id").alias("_tie"))
    sizes = keys.withColumn("_range", merkle._ranges(keys, 500, 1 << 16)).groupBy("_range").count().collect()
    assert 30 <= len(sizes) <= 41 and max(r["count"] for r in sizes) < 1500


def test_edits_are_located(spark):
    rows = spark.createDataFrame([("One. Two. Three. Four.", "One. Two. Drei. Four."), ("x", "x"), ("", "a")], "a string, b string")
    prints = merkle.fingerprints(merkle.fingerprints(rows, text_col="a", out="p"), text_col="b", out="q")
    assert [r[0] for r in prints.select(merkle.differing_paragraphs(F.col("p"), F.col("q"))).collect()] == [[2], [], [0]]


def test_samples_by_hash(spark):
    from spanforge.llm.common import smallest_hashes

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), F.col("id").alias("i"))
    want = {g: sorted((r["h"], r["i"]) for r in rows.withColumn("h", F.xxhash64("i")).where(F.col("g") == g).collect())[:50] for g in "ab"}
    got = smallest_hashes(rows, "g", "i", 50).collect()
    assert {g: sorted(r["i"] for r in got if r["g"] == g) for g in "ab"} == {g: sorted(i for _, i in v) for g, v in want.items()}
    same = rows.withColumn("i", F.lit(7))
    assert smallest_hashes(same, "g", "i", 50).count() == 100
    assert smallest_hashes(rows.limit(0), "g", "i", 50).count() == 0


# -- empty tables ---------------------------------------------------------------------------


def test_empty_tables(spark, stored, tmp_path):
    from spanforge.llm import registry

    stored([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, query in registry.queries().items():
        assert query(spark, str(tmp_path)).collect() == [], name
