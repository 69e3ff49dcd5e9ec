"""Operator 2: mixing sources to target weights, with DataFrame operations only.

Temperature mixing: a source's weight is its token share to the power of an exponent, normalised. The exponent is
searched on a grid of 2 ** -20, five bits in each pass over the table of sources, for the flattest mix that keeps a
repetition limit, or for the least flattening that reaches a target entropy.

The weights become a schedule. A source is dealt into hashed blocks of about BLOCK_ROWS documents. Each epoch visits
its blocks in a new order, and the documents of a block in a new order; the last epoch ends where the source's token
budget is used up. As the order is one of hashes, what the last epoch holds is told by one cut per source, so no row
is ranked or moved for it. A slot is a share of the whole schedule: in each, sources stand in their target weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.llm import common

GRID = 1 << 20
BLOCK_ROWS = 1024
SLOT_TOKENS = 1_000_000
#: What the registered query and the pipeline use: no source more than twice, each at least once.
REPETITION_LIMIT = 2.0


@dataclass
class Mix:
    exponent: float
    budget: float
    sources: DataFrame  # skey, tokens, n, weight, epochs, quota, blocks
    slots: int


def _source(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _row_key(key: str, text: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))))


def _block(row_key: str) -> Column:
    return (F.conv(F.substring(row_key, 1, 15), 16, 10).cast("long") % F.col("blocks")).cast("long")


def find_exponent(sources: DataFrame, repetition_limit: float | None = None, target_entropy: float | None = None, budget: float | None = None) -> tuple[float, float, float]:
    """Exponent, budget and the sum of the raised shares, from a table of tokens per source (each over 0).

    With both limits the repetition limit wins. If no exponent up to 1 keeps the repetition limit it is 1.
    """
    total = sources.agg(F.sum("tokens")).first()[0]

    def look(ks: list[int]) -> dict[int, dict]:
        a = F.col("k") / GRID
        share = F.col("tokens") / F.lit(float(total))
        raised = sources.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), share.alias("p"))
        found = raised.groupBy("k").agg(F.sum(F.pow("p", a)).alias("z"), F.sum(F.pow("p", a) * F.log("p")).alias("zl"), F.max(F.pow("p", a - 1)).alias("most"), F.min(F.pow("p", a - 1)).alias("least"))
        return {r.k: r.asDict() for r in found.collect()}  # 33 rows at most

    def repeats(r: dict) -> float:
        return r["most"] / r["least"] if budget is None else r["most"] * budget / (r["z"] * total)

    def entropy(r: dict) -> float:
        return math.log(r["z"]) - r["k"] / GRID * r["zl"] / r["z"]

    def first(holds) -> int:
        """The least k for which a condition holds that stays true from there on; GRID if there is none."""
        low, high = -1, GRID
        while high - low > 1:
            step = max(1, (high - low) // 32)
            ks = [k for k in range(low + 1, high, step)]
            found = look(ks)
            good = [k for k in ks if holds(found[k])]
            high, low = (good[0] if good else high), max([k for k in ks if k not in good], default=low)
        return high

    k = 0
    if target_entropy is not None:
        k = first(lambda r: entropy(r) < target_entropy)
        k = GRID if k == GRID and entropy(look([GRID])[GRID]) >= target_entropy else max(0, k - 1)
    if repetition_limit is not None:
        k = max(k, first(lambda r: repeats(r) <= repetition_limit * (1 + 1e-12)))
    at = look([k])[k]
    # Without a budget: the smallest with which every source is seen whole at least once.
    spent = budget if budget is not None else at["z"] * total / at["least"]
    return k / GRID, spent, at["z"]


def mix(slim: DataFrame, repetition_limit: float | None = REPETITION_LIMIT, target_entropy: float | None = None, budget: float | None = None) -> Mix | None:
    """Weights and quotas of a table of skey, row_key, tokens; None if it holds no tokens."""
    sums = common.cut(slim.groupBy("skey").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "sources")
    real = sums.where("tokens > 0")
    if real.isEmpty():
        return None
    exponent, spent, z = find_exponent(real, repetition_limit, target_entropy, budget)
    total = real.agg(F.sum("tokens")).first()[0]
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent)) / F.lit(z)).otherwise(F.lit(0.0))
    rate = F.when(F.col("tokens") > 0, F.round(F.col("weight") * F.lit(spent) / F.col("tokens"), 9)).otherwise(F.lit(1.0))
    sources = sums.withColumn("weight", weight).withColumn("rate", rate).withColumn("epochs", F.floor("rate").cast("long"))
    sources = sources.withColumn("quota", F.round((F.col("rate") - F.col("epochs")) * F.col("tokens")).cast("long"))
    sources = sources.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("long"))
    return Mix(exponent, spent, common.cut(sources, "mix"), max(1, math.ceil(spent / SLOT_TOKENS)))


def _block_key(epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.col("skey"), epoch.cast("string"), F.col("block").cast("string")))


def _doc_key(epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.col("row_key"), epoch.cast("string")))


def blocks_of(slim: DataFrame, mixed: Mix) -> DataFrame:
    """Each block in each epoch: its tokens and the tokens before it in that epoch, and its slot."""
    own = slim.join(mixed.sources.select("skey", "blocks"), "skey").withColumn("block", _block("row_key"))
    sums = own.groupBy("skey", "block").agg(F.sum("tokens").alias("block_tokens"))
    many = sums.join(mixed.sources, "skey").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    many = many.withColumn("block_key", _block_key(F.col("epoch"))).withColumn("part", F.substring("block_key", 1, 2))
    # The order is that of block_key. Prefix sums go by 256 parts of it, so that no window holds a large source whole.
    parts = many.groupBy("skey", "epoch", "part").agg(F.sum("block_tokens").alias("t"))
    before = Window.partitionBy("skey", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("skey", "epoch", "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("skey", "epoch", "part").orderBy("block_key").rowsBetween(Window.unboundedPreceding, -1)
    many = many.withColumn("inner_start", F.coalesce(F.sum("block_tokens").over(within), F.lit(0))).join(parts, ["skey", "epoch", "part"])
    start = F.col("part_start") + F.col("inner_start")
    budget = F.col("epochs") * F.col("tokens") + F.col("quota")
    slot = F.least(F.floor((F.col("epoch") * F.col("tokens") + start) / budget * mixed.slots), F.lit(mixed.slots - 1))
    return many.select("skey", "epoch", "block", "block_key", "block_tokens", "epochs", "quota", start.alias("start"), F.when(budget > 0, slot).otherwise(F.lit(0)).cast("long").alias("slot"))


def cuts_of(slim: DataFrame, mixed: Mix, blocks: DataFrame) -> DataFrame:
    """For each source, where its last epoch ends: the last block's key and the last document's key in it."""
    last = blocks.where("epoch = epochs and quota > 0 and start < quota and start + block_tokens >= quota")
    last = last.select("skey", "block", F.col("block_key").alias("cut_block"), (F.col("quota") - F.col("start")).alias("left"), "epochs")
    own = slim.join(mixed.sources.select("skey", "blocks"), "skey").withColumn("block", _block("row_key")).join(last, ["skey", "block"])
    keyed = own.withColumn("doc_key", _doc_key(F.col("epochs"))).groupBy("skey", "cut_block", "left", "doc_key").agg(F.sum("tokens").alias("tokens"))
    running = Window.partitionBy("skey").orderBy("doc_key").rowsBetween(Window.unboundedPreceding, -1)
    kept = keyed.withColumn("at", F.coalesce(F.sum("tokens").over(running), F.lit(0))).where(F.col("at") < F.col("left"))
    return kept.groupBy("skey", "cut_block").agg(F.max("doc_key").alias("cut_doc"))


def _scheduled(rows: DataFrame, mixed: Mix, cuts: DataFrame) -> DataFrame:
    """Rows with skey and row_key, once for each epoch that holds them; adds epoch, block and doc_key."""
    known = mixed.sources.select("skey", "epochs", "blocks").join(cuts, "skey", "left")
    met = rows.join(known, "skey").withColumn("block", _block("row_key"))
    key, doc = _block_key(F.col("epochs")), _doc_key(F.col("epochs"))
    partly = F.coalesce((key < F.col("cut_block")) | ((key == F.col("cut_block")) & (doc <= F.col("cut_doc"))), F.lit(False))
    times = F.col("epochs") + partly.cast("long")
    epochs = F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1))
    return met.withColumn("epoch", F.explode(epochs)).withColumn("doc_key", _doc_key(F.col("epoch")))


def _slim(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return docs.select(_source(source).alias("skey"), _row_key(key, text).alias("row_key"), common.n_words(text).alias("tokens"))


def mix_sources(docs: DataFrame, repetition_limit: float | None = REPETITION_LIMIT, target_entropy: float | None = None, budget: float | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, each once for every epoch that holds it, with all columns of docs and no others.

    Tokens are words; a null text has none, a null source is a source of its own. A source without any token is kept
    once. Rows that agree in key and text stand or fall together at a source's end. Without a budget no document is
    dropped. A table without tokens is returned as it is.
    """
    slim = common.cut(_slim(docs, key, text, source), "slim")
    mixed = mix(slim, repetition_limit, target_entropy, budget)
    if mixed is None:
        return docs
    cuts = common.cut(cuts_of(slim, mixed, blocks_of(slim, mixed)), "cuts")
    held, at = common.masked(docs)
    rows = held.select("*", _source(at[source]).alias("skey"), _row_key(at[key], at[text]).alias("row_key"))
    return _scheduled(rows, mixed, cuts).select(*held.columns).toDF(*docs.columns)


def schedule(docs: DataFrame, repetition_limit: float | None = REPETITION_LIMIT, target_entropy: float | None = None, budget: float | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as a schedule: key, source, n_tokens, epoch, block, slot, block_key, doc_key.

    It is read by slot, and in a slot by any shuffle of (source, epoch, block); a source's own order is
    (epoch, block_key, doc_key). Same cases as mix_sources; a table without tokens gives slot 0 and epoch 0 throughout.
    """
    columns = ["n_tokens", "epoch", "block", "slot", "block_key", "doc_key"]
    slim = common.cut(docs.select(F.col(key).alias("_id"), F.col(source).alias("_source"), _source(source).alias("skey"), _row_key(key, text).alias("row_key"), common.n_words(text).alias("tokens")), "slim")
    mixed = mix(slim, repetition_limit, target_entropy, budget)
    named = [F.col("_id").alias(key), F.col("_source").alias(source), F.col("tokens").alias("n_tokens")]
    if mixed is None:
        zero = F.lit(0).cast("long")
        return slim.withColumn("block", zero).select(*named, zero.alias("epoch"), "block", zero.alias("slot"), _block_key(zero).alias("block_key"), _doc_key(zero).alias("doc_key"))
    blocks = common.cut(blocks_of(slim, mixed), "blocks")
    cuts = common.cut(cuts_of(slim, mixed, blocks), "cuts")
    placed = _scheduled(slim, mixed, cuts).join(blocks.select("skey", "epoch", "block", "slot", "block_key"), ["skey", "epoch", "block"])
    return placed.select(*named, *columns[1:])


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of all documents: each source at least once and none over twice, as flat as that allows."""
    return schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = f"""
WITH slim AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS skey,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS row_key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens
  FROM documents),
sums AS (SELECT skey, sum(tokens)::BIGINT AS tokens, count(*) AS n, sum(sum(tokens)) OVER () AS total FROM slim GROUP BY skey),
expo AS (SELECT CASE WHEN max(tokens) <= {REPETITION_LIMIT} * min(tokens) * (1 + 1e-12) THEN 0
                ELSE ceil((1 - ln({REPETITION_LIMIT}) / ln(max(tokens) / min(tokens))) * {GRID} - 1e-6) / {GRID} END AS a,
                max(total) AS total FROM sums WHERE tokens > 0),
w AS (SELECT skey, sums.tokens, n, sums.total, a, pow(sums.tokens / sums.total, a) AS r FROM sums, expo),
z AS (SELECT sum(r) AS z, min(pow(tokens / total, a - 1)) AS least, max(total) AS total FROM w WHERE tokens > 0),
rate AS (SELECT skey, tokens, n, CASE WHEN tokens > 0 THEN round(r / z.z * (z.z * z.total / z.least) / tokens, 9) ELSE 1 END AS rate,
                z.z * z.total / z.least AS budget FROM w, z),
src AS (SELECT skey, tokens, n, floor(rate)::BIGINT AS epochs, round((rate - floor(rate)) * tokens)::BIGINT AS quota,
               ceil(n / {BLOCK_ROWS})::BIGINT AS blocks, greatest(1, ceil(budget / {SLOT_TOKENS}))::BIGINT AS slots FROM rate),
own AS (SELECT slim.*, src.epochs, src.quota, src.tokens AS source_tokens, src.slots,
               CAST('0x' || substr(row_key, 1, 15) AS BIGINT) % src.blocks AS block
        FROM slim JOIN src ON slim.skey = src.skey),
e AS (SELECT own.*, epoch, md5(skey || '|' || CAST(epoch AS VARCHAR) || '|' || CAST(block AS VARCHAR)) AS block_key,
             md5(row_key || '|' || CAST(epoch AS VARCHAR)) AS doc_key
      FROM own, (SELECT unnest(range(0, 4)) AS epoch) WHERE epoch <= epochs),
b AS (SELECT skey, epoch, block, block_key, sum(tokens) AS t FROM e GROUP BY ALL),
bs AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY skey, epoch ORDER BY block_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b),
k AS (SELECT skey, epoch, block, doc_key, sum(tokens) AS t FROM e GROUP BY ALL),
ks AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY skey, epoch, block ORDER BY doc_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM k)
SELECT e.doc_id, e.source, e.tokens AS n_tokens, CAST(e.epoch AS BIGINT) AS epoch, CAST(e.block AS BIGINT) AS block,
       CASE WHEN epochs * source_tokens + quota > 0
            THEN CAST(least(floor((e.epoch * source_tokens + bs.start) / (epochs * source_tokens + quota) * slots), slots - 1) AS BIGINT) ELSE 0 END AS slot,
       e.block_key, e.doc_key
FROM e JOIN bs ON e.skey = bs.skey AND e.epoch = bs.epoch AND e.block = bs.block
JOIN ks ON e.skey = ks.skey AND e.epoch = ks.epoch AND e.block = ks.block AND e.doc_key = ks.doc_key
WHERE e.epoch < e.epochs OR bs.start + ks.at < e.quota
"""
