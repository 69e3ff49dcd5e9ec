import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioscale.llm import common, pfor, token_files, token_ids


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49408).astype(np.uint32)
    data, starts = pfor.encode_blocks(ids)
    assert (pfor.decode_blocks(np.frombuffer(data, np.uint8), starts, n) == ids).all()
    found = pfor.TokenFile(pfor.encode_file([5, None], [n, 0], ids))
    assert (found.ids() == ids).all() and (found.ids(100, 300) == ids[100:300]).all()
    assert found.nulls.tolist() == [False, True]


def test_extreme_values():
    ids = np.array([0, 2**32 - 1, 7] * 50, np.uint32)
    data, starts = pfor.encode_blocks(ids)
    assert (pfor.decode_blocks(np.frombuffer(data, np.uint8), starts, 150) == ids).all()


TEXTS = ["Hello, World's 12 cats!", None, "", "  \t\n", "naïve Ærø ÀÉ, x.", "a b　c ẛ̣ İstanbul ΑΣ Σ", "don't <|endoftext|> can't", "word " * 3000, "y" * 5000, "é café, \x1c\x1d z\x85q", "😀 漢字かな", "a\x1cb \x1f c", "Wort### (x) end... it's &&& a-b x-- <|endoftext|>. LES!? q__`~ ﬁ é́ é", " lead  \x0b\x0c tail "]


def test_ids_equal_the_library():
    tokenizer = Tokenizer.from_file(token_ids.default_tokenizer())
    encode = token_ids.part_encoder(token_ids.default_tokenizer())
    ids, counts = encode(pa.array(TEXTS), 1)
    for text, ids in zip(TEXTS, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert ids.tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_of_random_parts_equal_the_library(monkeypatch):
    rng = np.random.default_rng(3)
    signs = [*"!\"#$%&()*+,-./:;=?@^_`~<|>'", *"abéÀßIİñ漢1٣ \t"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(3000)]
    monkeypatch.setattr(token_ids, "KEPT_BYTES", 20_000)
    monkeypatch.setattr(token_ids, "BLOCK", 50)
    tokenizer, encode = Tokenizer.from_file(token_ids.default_tokenizer()), token_ids.part_encoder(token_ids.default_tokenizer())
    for low in range(0, 3000, 500):
        ids, counts = encode(pa.array(texts[low : low + 500]), 1)
        for text, own in zip(texts[low : low + 500], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_files_against_brute_force(spark):
    rows = [(i * 7 % 50, TEXTS[i % len(TEXTS)], "x") for i in range(50)] + [(None, "null id", "y"), (3, "again", "z"), (3, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = common.fresh_path(spark, "tokens")
    got = token_files.read_token_files(spark, token_files.write_token_files(docs, path, file_ids=400), path).orderBy("start").collect()
    tokenizer, at = Tokenizer.from_file(token_ids.default_tokenizer()), 0
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    want = sorted((r[0] or 0, zlib.crc32(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in rows)
    assert sorted((r.doc_id or 0, zlib.crc32(r.ids)) for r in got) == want
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = common.fresh_path(spark, "tokens")
    assert token_files.read_token_files(spark, token_files.write_token_files(docs, path), path).count() == 0
