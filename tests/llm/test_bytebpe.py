"""Byte-level BPE by segment trees against the library."""

from __future__ import annotations

import base64
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from invoicelake.llm.bytebpe import TOGETHER, RankEncoder, Ranks, decode_ranks, merge_one, merge_pieces, rank_decode, rank_encode
from tests.llm.corpus import odd_texts, prose, table

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return Ranks(PATH, PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def samples() -> list[str]:
    rng = random.Random(5)
    alphabet = "abcdeé  ''sdtm\n\t\r\x0b\x1c\x85\xa0 .,!?123ÉßñЖ漢😀½"
    texts = [t or "" for _, t in odd_texts()] + ["".join(rng.choices(alphabet, k=80)) for _ in range(800)]
    texts += ["aaaa" * 700, "ab" * 900, "é" * 300, " " * 500, "'s", "we'll'd", "\n\n \n x", "<|endoftext|>", "x" * TOGETHER, "y" * (TOGETHER + 1)]
    return texts


def test_encoder_equals_library(ranks, library):
    texts = samples()
    ids, starts = RankEncoder(ranks).encode(texts)
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == library.encode_ordinary(text), text[:80]


def test_every_character_is_cut_as_the_library_cuts_it(ranks, library):
    tool = RankEncoder(ranks)
    wrong = []
    for block in range(0, 0x110000, 4096):
        texts = [f"a{c} {c}{c}1{c}  {c}" for c in map(chr, range(block, block + 4096)) if not 0xD800 <= ord(c) < 0xE000]
        ids, starts = tool.encode(texts)
        wrong += [t for k, t in enumerate(texts) if ids[starts[k] : starts[k + 1]].tolist() != library.encode_ordinary(t)]
    assert not wrong, (len(wrong), [hex(ord(t[1])) for t in wrong[:20]])


def test_both_ways_to_merge_agree(ranks):
    rng = random.Random(8)
    pieces = [bytes(rng.choices(b"etaoinsh ", k=rng.randint(2, TOGETHER))) for _ in range(400)]
    pieces += ["漢字éñ".encode() * 3, b"aa", b"a", b"zq" * 30]
    ids, sizes = merge_pieces(ranks, pieces)
    at = 0
    for piece, n in zip(pieces, sizes, strict=True):
        expected = [ranks.ranks[piece]] if piece in ranks.ranks else merge_one(ranks, piece)
        assert ids[at : at + n].tolist() == expected
        at += n


def test_store_is_bounded(ranks, library, monkeypatch):
    monkeypatch.setattr("invoicelake.llm.bytebpe.KEPT_PIECES", 6)
    tool = RankEncoder(ranks)
    for text in ["alpha beta gamma delta epsilon zeta eta", "beta zeta 漢字 theta", "zeta alpha 漢字 iota", "", "alpha"]:
        assert tool.encode([text])[0].tolist() == library.encode_ordinary(text)
        assert len(tool.codes) <= 6 and len(tool.ids) == tool.sizes.sum()


def test_columns_with_odd_rows(spark, library):
    texts = odd_texts()
    docs = table(spark, texts)
    coded = rank_encode(docs, PATH, PATTERN)
    assert set(coded.columns) == set(docs.columns)
    out = rank_decode(coded, PATH, PATTERN).select("doc_id", "text", "ids", "decoded").collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out) == sorted((i or -1, t or "") for i, t in texts)
    for r in out:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert rank_encode(docs.limit(0), PATH, PATTERN, decoded="decoded").count() == 0


def test_decode_skips_what_is_no_id(ranks):
    lists = pa.array([[72, None, -1, 10**6, 72], None, []], pa.list_(pa.int32()))
    token = ranks.tokens[72]
    assert decode_ranks(ranks, lists).to_pylist() == [token + token, None, b""]
    assert decode_ranks(ranks, lists.slice(2, 1)).to_pylist() == [b""]
    assert decode_ranks(ranks, lists.slice(0, 0)).to_pylist() == []


def test_long_text_round_trip(ranks, library):
    text = " ".join(prose(4, 40_000))
    ids, starts = RankEncoder(ranks).encode([text])
    assert ids.tolist() == library.encode_ordinary(text)
