"""BPE, token files and token counts against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from invoicelake.llm.bpe import Encoder, Vocabulary, bpe_decode, bpe_encode
from invoicelake.llm.files import with_scheme
from invoicelake.llm.tokencount import count_flat_files, token_counts, write_flat_files
from invoicelake.llm.tokenfile import EliasFano, dump_file, load_file, read_token_files, write_token_files
from tests.llm.corpus import odd_texts, table

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def library(path: str, special: bool = True) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    return tokenizer


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_library(path):
    rng = random.Random(3)
    alphabet = "abcdefg  ''sdtm\n\t.,!?123éÉßñ’“ğЖ漢😀"
    texts = [t or "" for _, t in odd_texts()] + ["".join(rng.choices(alphabet, k=60)) for _ in range(500)]
    texts += ["'s", " 's", "x 's'll\n'd", "we're WE'RE we'LL''s", "12'3'm", "<|endoftext|><|endoftext|>", "ab" * 4000]
    ids, starts = Encoder(Vocabulary(path)).encode(texts)
    for k, found in enumerate(library(path).encode_batch(texts, add_special_tokens=False)):
        assert ids[starts[k] : starts[k + 1]].tolist() == found.ids, texts[k][:80]


def test_encoder_forgets_words_beyond_its_store(monkeypatch):
    monkeypatch.setattr("invoicelake.llm.bpe.KEPT_WORDS", 5)
    tool, exact = Encoder(Vocabulary(WORDS)), library(WORDS)
    for text in ["alpha beta gamma delta epsilon zeta", "beta zeta 漢字 eta theta", "zeta alpha 漢字 iota", ""]:
        assert tool.encode([text])[0].tolist() == exact.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_columns(spark):
    texts = odd_texts()
    docs = table(spark, texts)
    coded = bpe_encode(docs, WORDS)
    assert set(coded.columns) == set(docs.columns)
    out = bpe_decode(coded, WORDS).select("doc_id", "text", "ids", "decoded").collect()
    exact = library(WORDS)
    assert len(out) == len(texts)
    for r in out:
        ids = exact.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == exact.decode(ids, skip_special_tokens=False)
    assert bpe_encode(docs.limit(0), WORDS, decoded="decoded").count() == 0


def test_decode_skips_unknown_ids_and_keeps_null(spark):
    lists = spark.createDataFrame([(1, [5, 60000, -1, 6]), (2, None), (3, [])], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe_decode(lists, WORDS).collect()}
    assert got == {1: library(WORDS).decode([5, 6]), 2: None, 3: ""}


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 2, 3], [2**62], list(range(0, 10**6, 997)), [0] * 700 + [10**9]])
def test_elias_fano_round_trip(values):
    made, end = EliasFano.load(memoryview(EliasFano.of(np.array(values, np.uint64)).dump()), 0)
    assert made.all().tolist() == values and [made.select(i) for i in range(len(values))] == values
    for a in (0, 1, 63, 64, 65, 200):
        for b in (a, a + 1, a + 64, a + 300):
            assert made.run(min(a, len(values)), min(b, len(values))).tolist() == values[a:b]
    with pytest.raises(IndexError):
        made.select(len(values))


def test_file_round_trip():
    data = b"".join(dump_file([None, -7, 3, 3], np.array([1, 2, 1, 3]), np.arange(7), 4))
    ids, ends, tokens = load_file(memoryview(data))
    assert ids == [None, -7, 3, 3] and ends.all().tolist() == [1, 3, 4, 7] and tokens.tolist() == list(range(7))
    with pytest.raises(ValueError):
        load_file(memoryview(b"x" * 80))


def test_token_files(spark):
    texts = odd_texts()
    files = write_token_files(table(spark, texts).repartition(3), BYTES, 2, file_tokens=500)
    out = read_token_files(spark, files, with_ids=True).orderBy("start").collect()
    exact, at = library(BYTES), 0
    assert [r["doc_id"] for r in out] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    by_id = {}
    for i, t in texts:
        by_id.setdefault(i, []).append(exact.encode(t or "", add_special_tokens=False).ids + [2])
    for r in out:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"] in by_id[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert files.count() > 1
    empty = write_token_files(table(spark, []), BYTES, 2)
    assert read_token_files(spark, empty).count() == 0


def test_token_counts(spark, tmp_path):
    texts = odd_texts()
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"]) for r in token_counts(table(spark, texts), WORDS, 49407).collect())
    exact = library(WORDS, special=False)
    count = lambda t: len(exact.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((i is None, i, count(t)) for i, t in texts)
    assert token_counts(table(spark, []), WORDS, 49407).count() == 0


def test_documents_over_many_pieces(spark, tmp_path, monkeypatch):
    texts = [(i, " ".join(["word"] * n)) for i, n in enumerate([0, 1, 37, 2, 0, 120, 5])]
    folder = str(tmp_path / "flat")
    order = write_flat_files(table(spark, texts).coalesce(1), WORDS, 49407, folder, piece_tokens=8)
    monkeypatch.setattr("invoicelake.llm.tokencount.BLOCK_TOKENS", 3)
    found = count_flat_files(spark, with_scheme(folder), 49407)
    got = order.join(found, ["stream", "ordinal"]).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [0, 1, 37, 2, 0, 120, 5]
    starts = [r["start"] for r in got]
    assert starts == np.cumsum([0, 1, 2, 38, 3, 1, 121]).tolist()


def test_unterminated_tail(spark, tmp_path):
    (tmp_path / "00000000-000000.flat").write_bytes(np.array([7, 9, 9, 3], "<u2").tobytes())
    got = count_flat_files(spark, f"file://{tmp_path}", 7).orderBy("ordinal").collect()
    assert [(r["start"], r["n_tokens"]) for r in got] == [(0, 0), (1, 3)]


def test_arrays_of_sliced_lists():
    from invoicelake.llm.bpe import decode_ids

    lists = pa.array([[1], [2, 3], None, [4]], pa.list_(pa.int32())).slice(1)
    assert decode_ids(Vocabulary(WORDS), lists).to_pylist() == [library(WORDS).decode([2, 3]), None, library(WORDS).decode([4])]
