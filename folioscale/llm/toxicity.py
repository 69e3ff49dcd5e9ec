"""Operator 4: toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding undoes disguises: case, compatibility forms, look-alike letters of other scripts, accents, digits and signs
written for letters, invisible characters. The lexicon holds beginnings of words (and short whole words) that labelled
toxic texts use and clean ones do not, weighted by their log odds. A hit inside an exception phrase does not count.
The hits' weights over the text's length give the density, which a logistic curve turns into a score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from folioscale.llm import common

#: Labelled rows that the lexicon and the curve are fitted on, at most (about: rows are chosen by a hash).
MAX_LABELLED = 20_000
#: Lengths of beginnings of words that can enter the lexicon.
LENGTHS = range(3, 9)
MIN_TOXIC = 3
MIN_SHARE = 0.002
MIN_WEIGHT = 2.0
#: The likelihood-ratio statistic from which a beginning counts as toxic.
MIN_EVIDENCE = 20.0
THRESHOLD = 0.3
#: Words added to every text's length: a single hit in a very short text is not all of it.
LENGTH_PRIOR = 20

#: Letters that look like Latin ones, and signs written for letters.
HOMOGLYPHS = dict(zip("абвгеёзікмнорстухуѕјһԁɡɑαβγεικνορτυχωℓ", "abbreezikmhopctyxysjhdgaabyeikvoptuxwl", strict=True))
SIGNS = dict(zip("0134578@$", "oieastbas", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
#: Harmless phrases that hold a word which is otherwise an insult.
EXCEPTIONS = ["pathetic fallacy", "clown fish", "clown car", "trash can", "trash bag", "trash bin", "trash talk", "trash collection", "scum line", "pond scum", "sore loser", "loser bracket", "stupid proof", "moron mountain", "the idiot by"]


def _table() -> dict[int, str]:
    table: dict[int, str] = {}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base.isalpha():
            table[code] = base.lower()
    for code in range(0x2FFF):
        char = chr(code)
        if code not in table and not char.isalnum() and unicodedata.category(char) != "Mn":
            table[code] = " "
    table |= {code: "" for code in range(0x300, 0x370)}
    table |= {ord(a): b for a, b in (HOMOGLYPHS | SIGNS).items()}
    table |= {ord(a): "" for a in INVISIBLE}
    table |= {ord("ß"): "ss", ord("æ"): "ae", ord("œ"): "oe", ord("ø"): "o", ord("'"): "", ord("’"): ""}
    return table


_TABLE = _table()


def fold(text: str) -> str:
    """The folded text: words of plain letters, every other character a space."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(_TABLE)


def beginnings(word: str) -> list[str]:
    """What of a folded word can enter the lexicon: a space, then its beginning; a short word also with its end."""
    own = [f" {word[:n]}" for n in LENGTHS if n <= len(word)]
    return [*own, f" {word} "] if len(word) <= LENGTHS[-1] else own


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    slope: float = 1.0
    offset: float = -4.0
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.lexicon.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            entry = f" {' '.join(fold(phrase).split())} "
            found.add_word(entry, (len(entry), None))
        found.make_automaton()
        return found

    def score(self, density: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.log1p(100 * density), -50, 50)))


def density_of(text: str, automaton) -> tuple[float, int]:
    """The hits' weights over the length in words, and the number of hits."""
    folded = f" {fold(text)} "
    hits: dict[int, float] = {}
    masks: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            masks.append((start, end))
        elif weight > hits.get(start, 0.0):
            hits[start] = weight
    if masks:
        hits = {at: w for at, w in hits.items() if not any(a <= at < b for a, b in masks)}
    if not hits:
        return 0.0, 0
    return sum(hits.values()) / (len(folded.split()) + LENGTH_PRIOR), len(hits)


_BUILT: dict[int, tuple[ToxicityModel, object]] = {}


def _automaton(model: ToxicityModel, key: int):
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = (model, model.automaton())
    return _BUILT[key][1]


def _strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def density_column(model: ToxicityModel, text: str = "text") -> Column:
    """struct<density, hits> of a text column."""
    key = hash((tuple(sorted(model.lexicon.items())), tuple(model.exceptions)))
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)  # entries of at most MAX_LABELLED texts

    @arrow_udf("struct<density:double,hits:long>")
    @common.released
    def measure(column: pa.Array) -> pa.Array:
        automaton = _automaton(shared.value, key)
        rows = [density_of(x, automaton) for x in _strings(column)]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())], names=["density", "hits"])

    return measure(F.col(text).cast("string"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def _evidence(toxic: Column, clean: Column, all_toxic: float, all_clean: float) -> Column:
    """Twice the log likelihood ratio of a beginning's own share of toxic texts against that of all texts."""
    n, p = toxic + clean, all_toxic / (all_toxic + all_clean)
    own = toxic / n
    part = lambda k, share, base: F.when(k > 0, k * F.log(share / base)).otherwise(0.0)
    return 2 * (part(toxic, own, p) + part(clean, 1 - own, 1 - p))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, text: str = "text") -> DataFrame:
    """text and toxic of documents with a label, those that are held out left aside, about limit rows at most."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~F.coalesce(held_out(), F.lit(False)))
    share = min(1.0, limit / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    return common.cut(rows.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, text: str = "text") -> ToxicityModel:
    """A model from the labelled documents that are not held out. Without both labels it scores every text alike."""
    sample = labelled_sample(docs, labels, limit, text)
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel({}, 0.0, math.log((toxic + 0.5) / (clean + 4.5)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([v[1] for v in held.values()], pa.int64()), pa.array([v[0] for v in held.values()], pa.int64())], names=["entry", "toxic", "clean"])
            held.clear()
            return out

        for batch in batches:
            for text_, label in zip(_strings(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                for entry in {b for word in set(fold(text_).split()) for b in beginnings(word)}:
                    held[entry][label] += 1
            if len(held) > 200_000:
                yield given()
        if held:
            yield given()

    counts = common.map_arrow(sample, count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    strong = counts.where(F.col("t") >= max(MIN_TOXIC, MIN_SHARE * toxic)).withColumn("weight", weight)
    strong = strong.where((F.col("weight") >= MIN_WEIGHT) & (_evidence(F.col("t"), F.col("c"), toxic, clean) >= MIN_EVIDENCE))
    rows = strong.orderBy(F.desc("weight"), "entry").collect()  # at least MIN_TOXIC of at most MAX_LABELLED texts hold each
    # A beginning that nearly always goes on alike gives way to the longer one, which clean words meet less easily.
    times = {r.entry: r.t for r in rows}
    vague = {p for q, t in times.items() if q[-1] != " " for p in (q[:n] for n in range(2, len(q))) if t >= 0.9 * times.get(p, math.inf)}
    lexicon: dict[str, float] = {}
    for r in sorted((r for r in rows if r.entry not in vague), key=lambda r: len(r.entry)):
        shorter = max((lexicon.get(r.entry[:n], 0.0) for n in range(2, len(r.entry))), default=0.0)
        if r.weight > shorter:  # else the shorter beginning says as much
            lexicon[r.entry] = r.weight
    model = ToxicityModel(lexicon)
    common.bound_batches(sample.sparkSession)
    pairs = sample.select("toxic", density_column(model)["density"].alias("density")).toPandas()  # about MAX_LABELLED rows
    x, y = np.log1p(100 * pairs["density"].to_numpy()), pairs["toxic"].to_numpy().astype(float)
    design, at = np.stack([np.ones(len(x)), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ at))
        gradient = design.T @ (y - p) - 0.01 * at
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2), gradient)
        at = at + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return ToxicityModel(lexicon, float(at[1]), float(at[0]))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and hits of every row of docs.

    A null text counts as empty; an empty text has no hit and the score of such texts. A null doc_id is not held out.
    Labels that are null are ignored; where a doc_id has several, one toxic label is enough. Repeated rows score alike.
    An empty table has no rows.
    """
    model = fit(docs, labels, text=text)
    common.bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", density_column(model, text).alias("_m"))
    return _scored(rows, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "_m.hits")


def _scored(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    linear = F.lit(model.offset) + F.lit(model.slope) * F.log1p(100 * F.col("_m.density"))
    scored = rows.withColumn("score", 1 / (1 + F.exp(-linear)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with its columns. Same cases as toxicity."""
    model = fit(docs, labels, text=text)
    common.bound_batches(docs.sparkSession)
    held, at = common.masked(docs)
    rows = held.select("*", density_column(model, at[text]).alias("_m"))
    return _scored(rows, model).where("predicted = 0").select(*held.columns).toDF(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
