"""Encoding against the tokenizers library, and packing against its own rules."""

from __future__ import annotations

import hashlib
import zlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import bpe, packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word " * 30_000 + "zq" * 20_000 + "\n\n  end"
TEXTS = [None, "", " ", "a", "don't  stop\n\n now", "<|endoftext|>", "x<|endoftext|> y", "\xa0 \u2003b", "日本語 🙂", LONG, "a", "a"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBpe(PATH)


PIECES = st.sampled_from(["'s", "'t", " ", "  ", "\n", "\t", "\xa0", "\u2003", "!'", "don't", "é", "日本", "🙂", "a", " the", "123", "<|endoftext|>", "<|end",
                          "\x85", "\x1c", '"', "\u02bc", "zq" * 40, "\r\n", "_", "٣", "\x00"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_ids_equal_the_library(reference, own, text):
    expected = reference.encode(text, add_special_tokens=False).ids
    ids = own.encode(text)
    assert list(array("I", ids)) == expected
    assert own.decode(ids) == reference.decode(expected, skip_special_tokens=False)


def test_digests_of_edge_cases(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.token_digests(docs, PATH).collect()))
    expected = []
    for i, text, _ in rows:
        ids = reference.encode(text or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(),
                         hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(expected)
    assert bpe.token_digests(docs.limit(0), PATH).count() == 0


def test_impossible_pairs_cut_certainly(own):
    text = b"thezqxjkvbwq"
    raw = [own.bytes_of[i] for i in array("I", own.encode(text.decode()))]
    assert all(not own.never[a, b] for token in raw for a, b in zip(token, token[1:]))


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(1, 60))
@settings(max_examples=200, deadline=None)
def test_fill_is_the_best_subset_sum(counts, capacity):
    sums = {0}
    for length, count in counts.items():
        sums = {s + length * k for s in sums for k in range(count + 1)}
    chosen = packing.best_fill(counts, capacity)
    assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= capacity)
    assert all(0 < k <= counts[n] for n, k in chosen.items())


def check_pieces(rows, ids_of, size=1024):
    by_doc, by_sequence = {}, {}
    for doc, start, length, crc, total, sequence, offset in rows:
        ids = ids_of[doc]
        assert total == len(ids) // 4 and length > 0
        assert crc == zlib.crc32(ids[4 * start:4 * (start + length)])
        by_doc.setdefault(doc, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for doc, ids in ids_of.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at
            at += length
        assert at == len(ids) // 4
    lengths = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        lengths.append(at)
    return lengths


def test_packing_holds_every_id_once(spark, reference):
    texts = TEXTS[:9] + [" ".join(["word"] * k) for k in range(1, 400, 3)] + [LONG]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").coalesce(1)
    found = packing.pack(docs, packing.rank_encoder(public_tokenizers.path(queries.RANKS), queries.SPECIALS), window=32)
    ids_of = {i: array("I", [*reference.encode(t or "", add_special_tokens=False).ids, 0]).tobytes() for i, t in rows}
    lengths = check_pieces([tuple(r) for r in found.collect()], ids_of)
    # only what a task has left at its end is shorter, and then a power of two
    assert all(n == 1024 or n & n - 1 == 0 for n in lengths)
    assert packing.pack(docs.limit(0), packing.rank_encoder(public_tokenizers.path(queries.RANKS))).count() == 0


@pytest.mark.parametrize("text", [" " * 3_000_000 + "a", "x" + "\n" * 1_200_000 + " \t" * 60_000 + "12 b", "a" + " " * 1_200_000, " " * 1_200_000 + "<|endoftext|>" + " " * 100_000 + "<|end",
                                  "a " + "\u2003" * 100_000 + "é" + " " * 99_999 + "b" + " " * 100_001 + "c"])
def test_packing_encodes_millions_of_blanks(reference, text):
    encode = packing.rank_encoder(public_tokenizers.path(queries.RANKS), queries.SPECIALS)()
    assert list(array("I", encode([text])[0])) == reference.encode(text, add_special_tokens=False).ids


def test_stores_are_bounded_by_bytes(monkeypatch):
    from tidewatch.llm import bpe as module

    import public_tokenizers

    monkeypatch.setattr(module, "KEPT", 20_000)
    own = module.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["漢字仮名" * 1_500 + str(i) for i in range(20)] + [" ".join(f"w{i}x{k}" for k in range(50)) for i in range(60)]
    plain = [own.encode(x) for x in texts]
    assert [own.decode(x) for x in plain] == texts and own.encode_batch(texts) == plain
    held = sum(len(k) + len(v or b"") for s in (own._chunk, own._word) for k, v in s.items())
    assert held < 20_000 and max(map(len, [*own._chunk, *own._word]), default=0) <= module.RARE
