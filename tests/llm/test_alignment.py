import hashlib
from collections import Counter

import numpy as np
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from folioscale.llm import alignment

TEXTS = [
    "Hello, World's 12 cats!", None, "", " ", "  two  leading and  inner ", "tab\tand\n\nline \n end ", "naïve Ærø ÀÉ, x. 漢字かな 😀", "<s>hi</s> <unk> <0x41> <|endoftext|>",
    "a ▁ b", "plain and ▁ mark", "Hello, World's 12 cats!", "Hello,", "\x00 nul \x1c sep   x", "ends with space ", "word " * 400, "y" * 3000, "éé é combining", "　wide nbsp x",
]


def brute_force(rows):
    path_a, path_b = alignment.default_paths()
    a_tok, b_tok = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a_tok.encode_special_tokens = True
    letters = alignment.byte_alphabet()
    assert len(letters) == 256 == len(set(letters.values()))
    name_a = {i: t for t, i in a_tok.get_vocab().items()}
    found, links_of = [], []
    for _, text in rows:
        ids = ([], []) if not text else (a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text))
        parts = [bytes(letters[x] for x in name_a[i]) for i in ids[0]], [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not text or any(b"".join(x) != (" " + text).encode() for x in parts):
            found.append((0, 0, 0, ""))
            links_of.append([])
            continue
        ends = [np.cumsum([*map(len, x)]).tolist() for x in parts]
        spans = [[(e - len(t), e) for e, t in zip(ends[k], parts[k])] for k in (0, 1)]
        links, j = [], 0
        for i, (low, high) in enumerate(spans[0]):
            while j < len(spans[1]) and spans[1][j][1] <= low:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < high:
                links.append((ids[0][i], ids[1][k]))
                k += 1
        groups, low = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            high = [ends[k].index(cut) + 1 for k in (0, 1)]
            groups.append("|".join(",".join(map(str, ids[k][low[k] : high[k]])) for k in (0, 1)))
            low = high
        found.append((len(ids[0]), len(ids[1]), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links_of.append(links)
    counts = Counter(x for links in links_of for x in links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    rows_out = [(doc, *n[:3], len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), n[3]) for (doc, _), n, links in zip(rows, found, links_of)]
    return rows_out, {(a, b, n, n == highest[b]) for (a, b), n in counts.items()}


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in row)


def test_measures_and_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    signs = [*"abcdeé123.,'! \n\t▁漢", " ", " ", " "]
    rows = [*enumerate(TEXTS), (None, "no number"), (3, "again"), (3, "again")]
    rows += [(100 + i, "".join(rng.choice(signs, rng.integers(1, 40)))) for i in range(400)]
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, n long, key string").repartition(3)
    measures, pairs = alignment.align_tokens(docs, chunk_bytes=200)
    want, want_pairs = brute_force(rows)
    assert sorted(map(key, measures.collect())) == sorted(map(key, want))
    assert {tuple(r) for r in pairs.select("a_id", "b_id", "count", "best").collect()} == want_pairs


def test_many_chunks_agree_with_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])[0])
    for size in (1000, 1 << 24):
        assert sorted(map(tuple, alignment.align_tokens(docs, chunk_bytes=size)[0].collect())) == want


def test_segments_that_are_forgotten_are_learnt_again(monkeypatch):
    known = alignment.Segments(*alignment.default_paths())
    monkeypatch.setattr(alignment, "RUN", 3)
    monkeypatch.setattr(alignment, "KEPT_BYTES", 1000)
    words = [f" w{i % 37}" for i in range(200)] + [" ▁", " a ▁ b"]
    plain = np.array([len(x.split()) == 1 for x in words])
    seen = {}
    for low in range(0, len(words), 20):
        own = known.find(words[low : low + 20], plain[low : low + 20])
        known.settle()
        for word, at in zip(words[low : low + 20], own.tolist()):
            now = (known.groups[at], known.numbers[at].tolist(), known.pool[known.first[at] :][: known.numbers[at, 3]].tolist())
            assert seen.setdefault(word, now) == now
    assert seen[" ▁"][0] == "" and seen[" w1"][0].endswith(";")


def test_empty_table(spark):
    measures, pairs = alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string"))
    assert measures.count() == 0 and pairs.count() == 0
