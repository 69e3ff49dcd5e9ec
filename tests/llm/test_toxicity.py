import random
import zlib
from collections import Counter

import pytest

from folioscale.llm import toxicity
from folioscale.llm.toxicity import ToxicityModel, fold


def test_fold():
    assert fold("1D10T").split() == ["idiot"]
    assert fold("Ｉｄіоt").split() == ["idiot"]  # full width and Cyrillic letters
    assert fold("ï-d​i,o.t é").split() == ["i", "di", "o", "t", "e"]
    assert fold("") == ""


def test_hits_and_exceptions():
    model = ToxicityModel({" idiot": 4.0, " trash": 3.0, " ass ": 2.0, " idiotic": 5.0})
    machine = model.automaton()
    n = toxicity.LENGTH_PRIOR
    assert toxicity.density_of("", machine) == (0.0, 0)
    assert toxicity.density_of("an idiot", machine) == (4.0 / (2 + n), 1)
    assert toxicity.density_of("an IDI0TIC thing", machine) == (5.0 / (3 + n), 1)
    assert toxicity.density_of("ass ass assess", machine) == (4.0 / (3 + n), 2)
    assert toxicity.density_of("the trash can, the trash", machine) == (3.0 / (5 + n), 1)


def brute_density(text, lexicon):
    words = fold(text).split()
    best = [max([w for entry, w in lexicon.items() if (f" {word} ").startswith(entry)], default=0.0) for word in words]
    return sum(best) / (len(words) + toxicity.LENGTH_PRIOR), sum(w > 0 for w in best)


def data():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        bad = i % 5 == 0
        for _ in range(len(text) // 12 + 2 if bad else 0):
            text[rng.randrange(len(text))] = rng.choice(["zwurk", "Zwurk", "ZWURKEN", "quixo" + rng.choice("abcde"), "zw0rg", "zwоrg"])
        rows.append((i, " ".join(text), int(bad)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = data()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "zwurk zwurk", "x"), (2000, None, "x"), (2001, "", "x"), (2001, "", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (3, None, 1), (5, 1, 1)], "doc_id long, toxic int, quality int")
    return docs, labels, rows


def test_held_out_accuracy_and_brute_force(tables):
    docs, labels, rows = tables
    model = toxicity.fit(docs, labels)
    assert {" zwurk", " zworg"} <= {*model.lexicon} and any(e.startswith(" quixo") for e in model.lexicon)
    machine = model.automaton()
    for _, text, _ in rows[:200]:
        got, want = toxicity.density_of(text, machine), brute_density(text, model.lexicon)
        assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-12
    got = toxicity.toxicity(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    right = [r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]
    assert len(right) > 150 and sum(right) >= 0.97 * len(right)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if not r.predicted)


def test_labels_of_held_out_rows_are_not_read(spark, tables):
    docs, labels, rows = tables
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows] + [(5, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, flipped).lexicon == toxicity.fit(docs, labels).lexicon


def test_no_labels(spark, tables):
    docs, labels, _ = tables
    got = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len({r.score for r in got}) == 1 and {r.predicted for r in got} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
