"""Operator 5: quality rules as robust multivariate outliers.

Each text becomes a vector of transformed statistics. For each language and source the minimum covariance determinant
is estimated over all rows that pass the base rules: from several starts (quartiles, all rows, small hashed subsets),
concentration steps keep the share H of rows with the smallest Mahalanobis distances and take their mean and covariance,
until the determinant settles; after two steps only the start with the smallest determinant goes on. A step is two aggregations with partial
sums: a histogram of distances gives each group's threshold, then sums and products give its moments. Nothing gathers a
group's rows.

Most texts have no symbol and no repeated line, so those statistics have no spread among the nearest rows. A statistic
is known no finer than what one more symbol, line, repeat, word or character changes, a mean length no finer than so
few words allow; the mean square of that step over
the same rows, which is the group's own, is added to each variance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from folioscale.llm import common

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rows that a language and source need for estimates of their own; smaller ones share those of their language, then of all.
MIN_GROUP = 100
#: With fewer rows than this there is no estimate and every row is kept.
MIN_ROWS = 20
H = 0.75
STEPS = 12
#: Share of rows of a normal distribution beyond the cut.
TAIL = 1e-6
#: Starts from small subsets, and about how many rows of a group each takes.
SUBSETS, SUBSET_ROWS = 2, 50
#: Words that a three-word window and its first repeat cover.
REPEAT_WORDS = 6
#: Spread of words' lengths over their mean: the mean length of few words is known no better than that allows.
WORD_SPREAD = 0.5
#: Transformed statistics. Counts over the square root of their chances have the same spread in texts of every length.
DIMENSIONS = ["log_words", "log_word_length", "root_symbols", "dup_lines", "repeat_words"]
_P = len(DIMENSIONS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def statistics(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word) of one text."""
    table: dict[bytes, int] = {}
    parts, chars = [], 0
    for words in common.word_blocks(text):
        new = table.setdefault
        parts.append(np.fromiter((new(w, len(table)) for w in words), np.int64, len(words)))
        chars += len(b"".join(words).decode("utf-8", "replace"))
    ids = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int64)
    n = len(ids)
    repeated = 0
    if n > 3:
        _, pair = np.unique(ids[:-1] * len(table) + ids[1:], return_inverse=True)
        _, at, count = np.unique(pair[:-1] * len(table) + ids[2:], return_inverse=True, return_counts=True)
        often = count[at] > 1
        if often.any():
            held = np.zeros(n, bool)
            for k in range(3):
                held[k : k + len(often)] |= often
            repeated = int(held.sum())
    seen, lines, dup = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    return n, chars, len(text) - len(text.translate(None, b"#*$%&|<>")), dup, repeated, lines


def statistics_column(text: str = "text") -> Column:
    @arrow_udf("struct<" + ",".join(f"{x}:long" for x in _STATS) + ">")
    @common.released
    def measure(column: pa.Array) -> pa.Array:
        rows = np.array([statistics(x) for x in common.text_bytes(column)], np.int64).reshape(-1, len(_STATS))
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(_STATS))], names=_STATS)

    return measure(F.col(text).cast("string"))


def _vector() -> list[tuple[Column, Column]]:
    """Each statistic and the square of its step."""
    words, chars, lines = (F.greatest(c, F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return [
        (F.log1p("n_words"), 1 / (words * words)),
        (F.log(chars / words), WORD_SPREAD**2 / words),
        (F.sqrt(F.col("n_symbols") / chars), 1 / chars),
        (F.col("n_dup_lines") / F.sqrt(lines), 1 / lines),
        (F.col("n_repeat_words") / F.sqrt(words), REPEAT_WORDS**2 / words),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi_square(dimensions: int, share: float) -> float:
    """The value below which that share of a chi-square distribution lies."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_share(dimensions / 2, mid / 2) < share else (low, mid)
    return high


def _distance() -> Column:
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + (1 if i == j else 2) * F.col(f"p{i}_{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}"))
    return F.greatest(total, F.lit(0.0))


#: Bins of the histogram of squared distances: 64 for each doubling.
def _bin() -> Column:
    return F.least(F.floor(F.log2(1 + _distance()) * 64), F.lit(1 << 13)).cast("int")


_PARAMS = "g string, start int, n long, logdet double, " + ", ".join([f"m{i} double" for i in range(_P)] + [f"p{i}_{j} double" for i, j in _PAIRS])


def consistency(h: float, dimensions: int) -> float:
    """What the covariance of the share h nearest rows of a normal distribution is short by."""
    return h / gamma_share(dimensions / 2 + 1, chi_square(dimensions, h) / 2)


def _solve(factor: float):
    def solve(batches):
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            count = np.maximum(rows["n"], 1).astype(float)
            mean = np.stack([rows[f"s{i}"] for i in range(_P)], 1) / count[:, None]
            cov = np.zeros((len(count), _P, _P))
            for i, j in _PAIRS:
                cov[:, i, j] = cov[:, j, i] = factor * (rows[f"s{i}_{j}"] / count - mean[:, i] * mean[:, j])
            for i in range(_P):
                cov[:, i, i] = np.maximum(cov[:, i, i], 0) + rows[f"r{i}"] / count
            inverse, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
            columns = [batch.column("g"), batch.column("start"), batch.column("n"), pa.array(logdet)]
            columns += [pa.array(mean[:, i].copy()) for i in range(_P)] + [pa.array(inverse[:, i, j].copy()) for i, j in _PAIRS]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "start", "n", "logdet", *[f"m{i}" for i in range(_P)], *[f"p{i}_{j}" for i, j in _PAIRS]])

    return solve


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(_P)] + [F.sum(f"r{i}").alias(f"r{i}") for i in range(_P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in _PAIRS]
    return common.cut(rows.groupBy("g", "start").agg(F.count("*").alias("n"), *sums).mapInArrow(_solve(factor), _PARAMS), "moments")


def subset(start: int, rows: Column, n: Column) -> Column:
    """Whether a row belongs to a small start: by a hash of its statistics, about SUBSET_ROWS rows of n."""
    return F.pmod(F.xxhash64(*[f"x{i}" for i in range(_P)], F.lit(start)), n) < rows


def fit(points: DataFrame, h: float = H) -> DataFrame:
    """Robust means and inverse covariances of each group g of points x0, r0, x1, ...: one row of _PARAMS per group."""
    quarter = points.groupBy("g").agg(*[F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"q{i}") for i in range(_P)], *[F.avg(f"r{i}").alias(f"r{i}") for i in range(_P)], F.count("*").alias("n"))
    quarter = common.cut(quarter, "quartiles")
    spread = [F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + F.col(f"r{i}") for i in range(_P)]
    middle = quarter.select("g", F.lit(0).alias("start"), "n", F.lit(0.0).alias("logdet"), *[F.col(f"q{i}")[1].cast("double").alias(f"m{i}") for i in range(_P)], *[(1 / spread[i] if i == j else F.lit(0.0)).alias(f"p{i}_{j}") for i, j in _PAIRS])
    sizes = quarter.select("g", F.col("n").alias("all"))
    started = points.join(sizes, "g").withColumn("start", F.explode(F.array(*map(F.lit, range(1, 2 + SUBSETS)))))
    plain = _moments(started.where((F.col("start") == 1) | subset(F.col("start"), F.lit(SUBSET_ROWS), F.col("all"))), 1.0)
    params = common.cut(middle.unionByName(plain), "moments")
    before = None
    for step in range(STEPS):
        met = points.join(params.drop("n", "logdet"), "g").withColumn("bin", _bin())
        counts = met.groupBy("g", "start", "bin").agg(F.count("*").alias("n"))
        upto = Window.partitionBy("g", "start").orderBy("bin")  # at most 8193 bins
        cut = counts.withColumn("upto", F.sum("n").over(upto)).join(sizes, "g").where(F.col("upto") >= F.ceil(F.col("all") * h)).groupBy("g", "start").agg(F.min("bin").alias("last"))
        params = _moments(met.join(cut, ["g", "start"]).where("bin <= last"), consistency(h, _P))
        if step == 1:
            best = params.groupBy("g").agg(F.min(F.struct("logdet", "start")).alias("b")).select("g", F.col("b.start").alias("start"))
            params = common.cut(params.join(best, ["g", "start"]), "moments")
        elif step > 1:
            now = params.agg(F.sum("logdet")).first()[0]
            if before is not None and (now is None or abs(now - before) <= 1e-6 * max(1.0, abs(before))):
                break
            before = now
    return params


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (with lang, source and the statistics' columns) with base_failed, group keys and the vector."""
    keyed = rows.withColumn("base_failed", base_failed())
    for key, column in (("_l", "lang"), ("_s", "source")):
        keyed = keyed.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")))
    vector = _vector()
    return keyed.withColumns({f"x{i}": x.cast("double") for i, (x, _) in enumerate(vector)} | {f"r{i}": r.cast("double") for i, (_, r) in enumerate(vector)})


def estimates(rows: DataFrame, h: float = H) -> DataFrame:
    """Robust means and inverse covariances for each language and source of a table of statistics."""
    good = _keyed(rows).where("not base_failed")
    counts = common.cut(good.groupBy("_l", "_s").agg(F.count("*").alias("n")), "groups")
    small = counts.where(F.col("n") < MIN_GROUP).groupBy("_l").agg(F.sum("n").alias("pool"))
    own, shared = F.concat_ws("\u0001", F.lit("own"), "_l", "_s"), F.concat_ws("\u0001", F.lit("lang"), "_l")
    group = F.when(F.col("n") >= MIN_GROUP, own).when(F.col("pool") >= MIN_GROUP, shared).otherwise(F.lit("all"))
    groups = common.cut(counts.join(small, "_l", "left").select("_l", "_s", group.alias("g")), "groups")
    points = common.cut(good.join(groups, ["_l", "_s"]).select("g", *[f"{c}{i}" for c in "xr" for i in range(_P)]), "points")
    params = fit(points, h).where(F.col("n") >= MIN_ROWS * h).drop("n", "logdet", "start")
    return common.cut(groups.join(params, "g").select("_l", "_s", *[f"m{i}" for i in range(_P)], *[f"p{i}_{j}" for i, j in _PAIRS]), "known")


def judge(rows: DataFrame, known: DataFrame, tail: float = TAIL) -> DataFrame:
    """rows with base_failed, distance (squared; null where there is no estimate or the base rules failed) and kept."""
    met = _keyed(rows).join(known, ["_l", "_s"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return met.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square(_P, 1 - tail), F.lit(True)))


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, the base statistics, n_lines, base_failed, distance and kept of every row.

    A null text has no words and fails the base rules; a null language or source is one of its own. Repeated rows are
    judged alike. An empty table has no rows.
    """
    common.bound_batches(docs.sparkSession)
    rows = common.cut(docs.select("doc_id", "lang", "source", statistics_column(text).alias("_m")).select("doc_id", "lang", "source", "_m.*"), "statistics")
    return judge(rows, estimates(rows)).select("doc_id", *_STATS[:5], "base_failed", "kept", "n_lines", "distance")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with its columns. Same cases as quality_rules.

    The statistics are taken twice, for the estimates and for the verdicts, so that no text is written in between.
    """
    common.bound_batches(docs.sparkSession)
    held, at = common.masked(docs)
    keys = [F.col(at["lang"]).alias("lang"), F.col(at["source"]).alias("source")]
    measured = held.select(*keys, statistics_column(at[text]).alias("m")).select("lang", "source", "m.*")
    known = estimates(common.cut(measured, "statistics"))
    rows = held.select("*", *keys, statistics_column(at[text]).alias("m")).select(*held.columns, "lang", "source", "m.*")
    return judge(rows, known).where("kept").select(*held.columns).toDF(*docs.columns)


def op5_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdict."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
