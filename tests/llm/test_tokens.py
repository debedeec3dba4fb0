"""Token counts and packing against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlake.llm import packing, token_counts

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_counts_match_the_library_on_every_code_point(path):
    library, count = Tokenizer.from_file(path), token_counts.Counter(path)
    points = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000] + [chr(i) for i in range(0x3000, 0x1FFFF, 97) if not 0xD800 <= i < 0xE000]
    bad = [hex(ord(c)) for c in points if count(f"a{c}b {c}{c}") != len(library.encode(f"a{c}b {c}{c}", add_special_tokens=False).ids)]
    assert not bad


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"abETH é'sΣ\n\t 0129<|>!,.\x1c中", "<|endoftext|>", "the", "ing", "'ll"]), max_size=60).map("".join))
def test_counts_match_the_library_on_mixed_texts(text):
    for path in (WORD, BYTE):
        assert token_counts.counter(path)(text) == len(_library(path).encode(text, add_special_tokens=False).ids)


_KNOWN = {}


def _library(path):
    return _KNOWN.setdefault(path, Tokenizer.from_file(path))


def test_count_of_awkward_rows(spark, odd, empty):
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, WORD).collect()}
    for r in odd.collect():
        text = r.text or ""
        n = len(_library(WORD).encode(text, add_special_tokens=False).ids)
        assert got[r.doc_id, len(text.encode())] == (n, n > 2048)
    assert token_counts.count_tokens(odd, WORD).count() == odd.count() and token_counts.count_tokens(empty, WORD).count() == 0


def check_packed(pieces, docs, window):
    """Every id in exactly one piece, sequences gapless; returns the padding over all ids."""
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    want = {}
    for doc, text in docs:
        ids = np.array(_library(BYTE).encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.setdefault((doc, len(ids)), []).append(ids)
    assert by_doc.keys() == want.keys()
    for key, rows in by_doc.items():
        got = sorted((r.start, bytes(r.ids)) for r in rows)
        expected = want[key]
        assert sum(len(b) for _, b in got) == sum(4 * len(ids) for ids in expected)
        assert all(b == expected[0][s : s + len(b) // 4].tobytes() for s, b in got)
    padding = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) // 4
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / sum(r.length for r in pieces)


def test_packing_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    pieces = packing.pack_documents(docs, BYTE).collect()
    assert check_packed(pieces, [(r.doc_id, r.text) for r in docs.collect()], 2048) < 0.02


def test_packing_merges_leftovers_in_levels(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).repartition(7)
    pieces = packing.pack_documents(docs, BYTE, window=256, open_windows=3).collect()
    assert check_packed(pieces, [(r.doc_id, r.text) for r in docs.collect()], 256) < 0.05


def test_packing_awkward_rows(odd, empty):
    pieces = packing.pack_documents(odd, BYTE).collect()
    check_packed(pieces, [(r.doc_id, r.text) for r in odd.collect()], 2048)
    assert packing.pack_documents(empty, BYTE).count() == 0


def test_window_crc_is_of_little_endian_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(bytes([1, 0, 0, 0, 2, 0, 0, 0]))
