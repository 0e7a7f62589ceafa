import hashlib
import random
import struct

import pytest

from stratapool.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks())


@pytest.fixture(scope="module")
def tik(codec):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


CASES = ["", " ", "  ", "a", " a", "  a", "a  ", "a \n b", "\n\nx", "it's 'still 'S we'll they'reX ''s \"'s '", " 's", "\n's", "x'", "don't've'd'm", "12ab 3½", "a 　b   c", "日本語 テスト", "😀😀 é́x", "<|endoftext|>", "!!! ... ?", "a\x00b", "ß" * 50, "'re", "'r", "'l", "'ll'", "x\x1c\x1dy", "   'ts"]


def test_cases_against_tiktoken(codec, tik):
    want = [tik.encode_ordinary(t) for t in CASES]
    for texts, wanted in ((CASES, want), *(([t], [w]) for t, w in zip(CASES, want))):
        got = codec.encode(texts)
        assert [list(struct.unpack(f"<{len(g) // 4}I", g)) for g in got] == wanted
        assert [codec.decode(g, codec.offsets(g)) for g in got] == [t.encode() for t in texts]


def test_random_strings_against_tiktoken(codec, tik):
    rng = random.Random(3)
    letters = "abst'rvelmd \n\t1½é日!< ́😀"
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(3000)] + ["".join(rng.choices(letters, k=2000))]
    assert [list(struct.unpack(f"<{len(g) // 4}I", g)) for g in codec.encode(texts)] == [tik.encode_ordinary(t) for t in texts]


def test_long_run(codec, tik):
    for t in ("ab" * 5000, "!" * 3000, " " * 3000 + "x"):
        assert list(struct.unpack("<%dI" % (len(g := codec.encode([t])[0]) // 4), g)) == tik.encode_ordinary(t)


def test_table_against_tiktoken(spark, sf_dir, tik):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text, "x") for r in docs.collect()] + [(None, None, "y"), (7, "", "z"), (7, "", "z")]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    want = []
    for d, t, _ in rows:
        ids = tik.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    apart = bpe.decode(bpe.encode(docs)).orderBy("doc_id").collect()
    assert [(r.doc_id, bytes(r.decoded).decode()) for r in apart] == [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]


def test_slices_merged_side_by_side(codec):
    rng = random.Random(5)
    tokens = list(codec.ranks)
    joined = [b"".join(rng.choices(tokens, k=rng.randrange(1, 7))) for _ in range(3000)]
    raw = [rng.randbytes(rng.randrange(1, 90)) for _ in range(500)]
    pieces = list({*joined, *raw, *(b"a" * n for n in range(1, 90)), *(b"ab" * n for n in range(1, 45))})
    assert codec.merge_all(pieces) == {p: codec.merge(p) for p in pieces}
    assert codec.merge_all([]) == {}


def test_pair_table(codec):
    import numpy as np

    a, b = np.array([[k >> 32, k & 0xFFFFFFFF] for k in codec.pairs]).T
    assert codec.table.find(a, b).tolist() == list(codec.pairs.values())
    assert (codec.table.find(a, np.full(len(b), codec.size)) == codec.size).all()


def test_slices_used_again_stay_in_the_cache(monkeypatch):
    own = bpe.Codec(bpe.read_ranks())
    monkeypatch.setattr(bpe, "CACHE", 40)
    merged = []
    monkeypatch.setattr(own, "merge_all", lambda new: merged.extend(new) or bpe.Codec.merge_all(own, new))
    texts = [" ".join(["zqxjk", *(f"w{chr(97 + k)}{chr(97 + i % 26)}q" for k in range(8))]) for i in range(40)]
    got = [own.encode([t]) for t in texts]
    assert [g for [g] in got] == bpe.Codec(bpe.read_ranks()).encode(texts) and merged.count(b"zqxjk") == 1 and len(own.cache) + len(own.older) <= 2 * 40


def test_many_slices_are_merged_once(monkeypatch):
    """150,000 slices that come again: the cache holds them, so that none is merged twice."""
    own = bpe.Codec(bpe.read_ranks())
    merged = []
    monkeypatch.setattr(own, "merge_all", lambda new: merged.extend(new) or dict.fromkeys(new, b"\1\0\0\0"))
    texts = [" " + " ".join(f"x{chr(97 + i // 600)}{chr(97 + i // 24 % 25)}{chr(97 + i % 24)}{chr(97 + j // 10)}q{chr(97 + j % 10)}" for j in range(250)) for i in range(600)]
    for k in (*range(0, 600, 50), *range(0, 600, 50)):
        own.encode(texts[k : k + 50])
    assert len(merged) == len(set(merged)) == 150_000


@pytest.mark.parametrize("cache, at_once", [(1 << 20, 1 << 16), (30, 7)])
def test_slices_of_all_sizes_against_tiktoken(tik, monkeypatch, cache, at_once):
    monkeypatch.setattr(bpe, "CACHE", cache)
    monkeypatch.setattr(bpe, "SLICES", at_once)
    own, rng = bpe.Codec(bpe.read_ranks()), random.Random(7)
    words = ["".join(rng.choices(letters, k=n)) for letters in ("abcthe", "éßñ", "日本", "😀") for n in (1, 2, 4, 5, 7, 8, 9, 14, 15, 16, 17, 31, 32, 63, 64, 65, 90, 200)]
    pieces = [*words, "\0", "\0\0", "a\0", "\0a", "", " "]
    texts = ["", *(" ".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(150)), "", *pieces, "".join(words), ""]
    want = [tik.encode_ordinary(t) for t in texts]
    for some, wanted in ((texts, want), (texts[::-1], want[::-1])):
        ids, cuts = own.encode_all(some)
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == wanted
        offsets = own.offsets_all(ids, cuts)
        data, stop = own.decode_all(ids, offsets, cuts)
        assert [data[a:b].tobytes().decode() for a, b in zip(stop, stop[1:])] == some
        assert bpe.binaries(offsets, cuts).to_pylist() == [own.offsets(i) for i in bpe.binaries(ids, cuts).to_pylist()]
    assert own.encode([]) == [] and own.encode(["", ""]) == [b"", b""]


def test_slices_are_found_by_their_whole_key(monkeypatch):
    import numpy as np

    monkeypatch.setattr(bpe.Slices, "slots", lambda self, low, high: (low % np.uint64(3)).view(np.int64) + self.mask - 2)  # all collide, at the end
    slices, rng = bpe.Slices(), random.Random(8)
    known = sorted({bytes(rng.choices(b"\0ab", k=rng.randrange(1, 16))) for _ in range(400)})
    data = np.frombuffer(b"".join(known) + bytes(16), np.uint8)
    size = np.array([len(k) for k in known])
    low, high = bpe.keys(data, np.cumsum(size) - size, size)
    counts = size % 4 + 1
    half = np.arange(len(known)) % 2 == 0
    slices.add(low[half], high[half], np.repeat(np.flatnonzero(half), counts[half]), counts[half])
    spans = slices.find(low, high)
    assert (spans[~half] == 0).all() and (spans[half] & 15).tolist() == counts[half].tolist() and len(slices) == half.sum()
    assert slices.ids[spans[half] >> 4].tolist() == np.flatnonzero(half).tolist()
