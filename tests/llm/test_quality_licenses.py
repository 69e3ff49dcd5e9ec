import math
import random
import re
from collections import Counter

import numpy as np

from folioscale.llm import licenses, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    held = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            held |= {i, i + 1, i + 2}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(held), lines


def texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioustrnlé") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    out = []
    for i in range(700):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(45, 400))]
        if i % 20 == 0:
            words = [w + rng.choice(["***", "$$$", "&&&"]) for w in words]
        if i % 33 == 0:
            words = words[:30] * 4
        out.append("\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12)))
    return [*out, None, "", " \n\t", "one two", "a b c", "x" * 5000, "* " * 80, "same line\n" * 60]


def test_statistics():
    for text in texts():
        assert quality.statistics((text or "").encode()) == brute_statistics(text)


def test_long_texts_in_blocks(monkeypatch):
    from folioscale.llm import common

    monkeypatch.setattr(common.word_blocks, "__defaults__", (50,))
    for text in texts()[:40]:
        assert quality.statistics((text or "").encode()) == brute_statistics(text)


def share_below(x, degrees):
    """The chi-square distribution for 5 and 7 degrees of freedom, in closed form."""
    tail = 1 + x / 3 + (x * x / 15 if degrees == 7 else 0)
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * tail


def quantile(share):
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if share_below(mid, 5) < share else (low, mid)
    return high


def vector(s):
    words, chars, _, _, _, lines = (max(v, 1) for v in s)
    x = [math.log1p(s[0]), math.log(chars / words), math.sqrt(s[2] / chars), s[3] / math.sqrt(lines), s[4] / math.sqrt(words)]
    return x, [1 / words**2, 0.25 / words, 1 / chars, 1 / lines, 36 / words]


def brute_fit(x, step, h=0.75, starts=12):
    """Concentration steps in memory from many random starts."""
    rng, best = np.random.default_rng(0), None
    need, factor = math.ceil(h * len(x)), h / share_below(quantile(h), 7)
    for start in range(starts):
        own = np.arange(len(x)) if not start else rng.choice(len(x), min(len(x), 40), replace=False)
        scale = 1.0
        for _ in range(60):
            mean, cov = x[own].mean(0), np.cov(x[own].T, bias=True) * scale + np.diag(step[own].mean(0))
            d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
            new, scale = np.argsort(d, kind="stable")[:need], factor
            if len(new) == len(own) and set(new) == set(own):
                break
            own = new
        value = np.linalg.slogdet(cov)[1]
        if best is None or value < best[0]:
            best = (value, mean, np.linalg.inv(cov))
    return best


def test_verdicts_against_brute_force(spark):
    data = [(i, t, ["en", "de", None][i % 3 if i % 7 else 0], ["a", "b"][i % 2], 9) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert len(got) == len(data)
    stats = {i: brute_statistics(t) for i, t, *_ in data}
    failed = {i: s[0] < 50 or 100 * s[4] > 50 * s[0] for i, s in stats.items()}
    groups = {}
    for i, _, lang, source, _ in data:
        if not failed[i]:
            groups.setdefault((lang, source), []).append(i)
    pools = {}
    for (lang, source), own in groups.items():
        if len(own) >= quality.MIN_GROUP:
            pools[(lang, source)] = own
    rest = {k: v for k, v in groups.items() if k not in pools}
    for lang in {k[0] for k in rest}:
        own = [i for k, v in rest.items() if k[0] == lang for i in v]
        pools[(lang,) if len(own) >= quality.MIN_GROUP else "all"] = pools.get("all", []) + own if len(own) < quality.MIN_GROUP else own
    cut = quantile(1 - 1e-6)
    assert abs(cut - 35.888) < 0.01
    rejected = agree = 0
    for own in pools.values():
        both = [vector(stats[i]) for i in own]
        x, step = (np.array(v) for v in zip(*both, strict=True))
        _, mean, inverse = brute_fit(x, step)
        for i, d in zip(own, np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean), strict=True):
            agree += abs(got[i].distance - d) <= 0.1 * max(1, d)
            assert got[i].kept == (got[i].distance <= cut)
            if abs(d - cut) > 0.1 * cut:
                assert got[i].kept == (d <= cut)
            rejected += not got[i].kept
    assert agree >= 0.85 * sum(map(len, pools.values()))
    assert rejected >= 20
    for i, s in stats.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s[:5] and r.base_failed == failed[i]
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.quality_rules(docs.limit(0)).count() == 0 == quality.keep_good(docs.limit(0)).count()


def test_the_estimate_decides(spark):
    """In all groups of the labelled data the spread of the rows, not the step, makes up most variances that have any."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.common.cut(docs.select("lang", "source", quality.statistics_column().alias("m")).select("lang", "source", "m.*"))
    for r in quality.estimates(rows).collect():
        precision = np.zeros((5, 5))
        for i in range(5):
            for j in range(i, 5):
                precision[i, j] = precision[j, i] = r[f"p{i}_{j}"]
        spread = np.sqrt(np.diag(np.linalg.inv(precision)))
        assert 0.4 < spread[0] < 2 and 0.01 < spread[1] < 0.3  # of the data: no step is near


def test_few_rows_are_kept(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "en", "a"), (2, "short", "en", "a")], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()} == {1: True, 2: False}


def test_licenses(spark):
    mit = licenses.WHOLE[0][1]
    rows = [
        (1, "prose\nLicensed under CC BY-NC 4.0.\nmore"),
        (2, "  RELEASED under the MIT Licence "),
        (3, "Copyright (c) 2020 Someone\n\n" + mit.replace("\n", "\n   ").replace('"', "'")),
        (4, mit + " extra"),
        (5, None),
        (6, ""),
        (7, "...\n---"),
        (8, "SPDX-License-Identifier: Apache-2.0\nthis software is licensed under the GNU General Public License, version 3!"),
        (8, "SPDX-License-Identifier: Apache-2.0"),
    ]
    got = licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string")).collect()
    assert sorted((r.doc_id, r.line, r.license_id) for r in got) == [(1, 2, "CC-BY-NC-4.0"), (2, 0, "MIT"), (2, 1, "MIT"), (3, 0, "MIT"), (8, 0, "Apache-2.0"), (8, 1, "Apache-2.0"), (8, 1, "Apache-2.0"), (8, 2, "GPL-3.0")]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    own = licenses.scan(spark.createDataFrame([(1, "Do as YOU like!"), (2, "x\nLicensed under CC BY 4.0")], "doc_id long, text string"), [("own", "do as you like")]).collect()
    assert sorted((r.doc_id, r.line, r.license_id) for r in own) == [(1, 0, "own"), (1, 1, "own"), (2, 2, "CC-BY-4.0")]


def test_reserved_rights_and_entire_bsd_texts(spark):
    rows = [(1, "prose\nAll rights reserved.\nmore"), (2, "ALL  RIGHTS-RESERVED"), (3, "Copyright 2020 Someone\n" + licenses._BSD["BSD-3-Clause"].replace("\n", "\n\n")), (4, licenses._BSD["BSD-2-Clause"]), (7, "reserved seats")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license_id) for r in got if r.line == 0} == {(2, "All-Rights-Reserved"), (3, "BSD-3-Clause"), (4, "BSD-2-Clause")}
    assert {(r.doc_id, r.line, r.license_id) for r in got if r.doc_id < 3} == {(1, 2, "All-Rights-Reserved"), (2, 0, "All-Rights-Reserved"), (2, 1, "All-Rights-Reserved")}


def test_texts_are_only_passed_over_when_they_cannot_match(spark):
    rows = [(1, "Liwww.censed under CC BY 4.0"), (2, "RE\u00adleased under CC0 1.0"), (3, "Released -- under: CC0 1.0!"), (4, "plain " * 40_000), (None, "x\nAll RIGHTS reserved"), (6, "rehttps://leased under CC BY 4.0")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line, r.license_id) for r in got} == {(1, 0, "CC-BY-4.0"), (1, 1, "CC-BY-4.0"), (3, 0, "CC0-1.0"), (3, 1, "CC0-1.0"), (None, 2, "All-Rights-Reserved"), (6, 0, "CC-BY-4.0"), (6, 1, "CC-BY-4.0")}
    assert licenses.anchors_of(["Copyright: all permission\ndo as you like"]) is None
    noted = licenses.scan(spark.createDataFrame([(1, "do as you like")], "doc_id long, text string"), [("own", "Copyright: all permission\ndo as you like")]).collect()
    assert {(r.line, r.license_id) for r in noted} == {(0, "own"), (1, "own")}
    whole = [(i, text) for i, (_, text) in enumerate(licenses.WHOLE)]
    found = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(whole, "doc_id long, text string")).collect() if r.line == 0}
    assert found == {i: name for i, (name, _) in enumerate(licenses.WHOLE)}
