"""Finding and reading over one release: a request names the control record it was made under and is refused under another.

A search reads the entries of the release in force that may be read, checks their texts against their digests, ranks them
for a question and its rewrites, and gives one page of candidates, each with where its excerpt comes from and the request
that reads it on. The control record is read before and after; if it has changed, nothing is given out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.functions.text import tokens
from folioscale.operators import lexical, views
from folioscale.plans import build, commits
from folioscale.session import kept, scratch_path, table

#: Characters of a question, candidates of a page, characters of a page of a source.
MOST_QUESTION, MOST_PAGE, PAGE_CHARACTERS = 4000, 20, 12_000


@dataclass(frozen=True)
class Request:
    """A source to be read from an offset on, as it stood under a control record."""

    token: str
    document_id: str
    revision_id: str
    history: bool = False
    offset: int = 0


@dataclass(frozen=True)
class Found:
    """One page of candidates: their table, how many there are, the next offset (None: no more), and what they were found under."""

    candidates: DataFrame
    matched: int
    next_offset: int | None
    token: str


def readable(pinned: commits.Pinned, history: bool = False) -> DataFrame:
    """document_id, revision_id, relative, kind, level, status, bucket, historical and text of what may be read of a release.

    A text that is not the one its entry and its extraction name raises an error when it is read.
    """
    parts = [(pinned.table("current"), "current"), (pinned.table("leads"), "lead"), (pinned.table("snapshots"), "history")]
    shape = parts[0][0].columns
    rows = None
    for rank, (own, bucket) in enumerate(parts):
        own = own.select(*shape, F.lit(rank).alias("rank"), F.lit(bucket).alias("part"))
        rows = own if rows is None else rows.unionByName(own)
    revision = F.concat(F.lit("rev-"), "sha", F.lit("-"), F.substring("extraction_id", 1, 12))
    entries = rows.select(F.col("document_id").alias("doc"), revision.alias("revision"), F.struct(*[c for c in shape if c != "usable"]).alias("entry"), F.struct("rank", "relative").alias("place"), F.col("part").alias("bucket"), "status", "usable", F.col("usable").alias("legacy_complete"))
    none = entries.select("doc").limit(0)  # what is stopped has no entry in force, and a stopped status is never read
    found = views.readable_entries(entries, none, history).select(F.col("doc").alias("document_id"), F.col("revision").alias("revision_id"), "historical", *[f"entry.{c}" for c in ("relative", "sha", "kind", "level", "status", "bucket", "extraction_id", "text_sha")])
    texts = pinned.table("extractions").select("extraction_id", "text", F.col("text_sha").alias("_sha"))
    met = found.join(texts, "extraction_id", "left")
    actual = F.sha2("text", 256)
    sound = F.coalesce((actual == F.col("_sha")) & (actual == F.col("text_sha")), F.lit(False))
    return met.withColumn("text", F.when(sound, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("the text of "), "relative", F.lit(" is not the one its entry names"))))).drop("_sha")


def _words(spark: SparkSession, questions: Sequence[str]) -> list[list[str]]:
    rows = spark.createDataFrame(list(enumerate(questions)), "i int, q string").select("i", tokens(F.col("q")).alias("t"))
    return [list(dict.fromkeys(r.t)) for r in sorted(rows.collect())]  # a question and two rewrites


def discover(spark: SparkSession, root: str, question: str, rewrites: Sequence[str] = (), limit: int = 10, offset: int = 0, history: bool = False, token: str | None = None) -> Found:
    """Candidates for a question, best first: rank, score, hits, document_id, revision_id, relative, kind, level, status,
    historical, excerpt, start and end of the excerpt, total (characters of the text).

    token: that of an earlier page, which must still be in force (Conflict otherwise). Rewrites are ranked too, and the
    rankings fused. A question without words, or a page outside the limits, is an error.
    """
    if not question.strip() or len(question) > MOST_QUESTION or not 1 <= limit <= MOST_PAGE or offset < 0:
        raise ValueError("a question has 1 to 4000 characters, a page 1 to 20 candidates, an offset is not negative")
    asked = spark.createDataFrame([(question, list(rewrites))], "q string, r array<string>").select(views.rewrites_valid(F.col("q"), F.col("r"))).first()[0]
    if not asked:
        raise ValueError("two rewrites at most, that differ from each other and the question")
    pinned = commits.Pinned(spark, root)
    if token is not None and token != pinned.control.token:
        raise commits.Conflict("the page was found under another control record")
    words = [x for x in _words(spark, [question, *rewrites]) if x]
    if not words:
        raise ValueError("a question without words")
    docs = kept(readable(pinned, history).withColumn("key", F.struct("document_id", "revision_id")), "readable")
    rankings = lexical.bm25_rankings(docs, words, "key")
    best = kept(lexical.best_windows(reduce(DataFrame.unionByName, rankings)), "best")
    scored = lexical.fuse(rankings) if len(rankings) > 1 else best.select("key", F.col("score").alias("fusion_score"), F.lit(1).cast("long").alias("hits"))
    scored = kept(scored, "scored")
    matched = scored.count()
    order = [F.desc("fusion_score"), F.col("key")]
    page = scored.orderBy(*order).limit(offset + limit).withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > offset)  # a page at most
    met = page.join(best.select("key", "start"), "key").join(docs, "key")
    excerpt = F.substring("text", F.col("start") + 1, F.lit(lexical.EXCERPT))
    columns = ["document_id", "revision_id", "relative", "kind", "level", "status", "historical"]
    out = met.select("rank", F.col("fusion_score").alias("score"), "hits", *columns, excerpt.alias("excerpt"), "start", (F.col("start") + F.length(excerpt)).alias("end"), F.length("text").alias("total"))
    out = kept(out, "page")
    pinned.check()
    return Found(out, matched, offset + limit if offset + limit < matched else None, pinned.control.token)


def requests(found: Found, history: bool = False) -> list[Request]:
    """What reads the candidates of a page, in their order."""
    rows = found.candidates.orderBy("rank").select("document_id", "revision_id").collect()  # a page
    return [Request(found.token, r.document_id, r.revision_id, history) for r in rows]


def read_source(spark: SparkSession, root: str, request: Request, size: int = PAGE_CHARACTERS) -> tuple[dict, Request | None]:
    """A page of a source's text with where it stands, and the request for the next one (None: it was the last).

    Conflict if another control record is in force, before or after; ValueError for what may not be read or an offset
    behind the end.
    """
    pinned = commits.Pinned(spark, root)
    if request.token != pinned.control.token:
        raise commits.Conflict("the request was made under another control record")
    own = readable(pinned, request.history).where((F.col("document_id") == request.document_id) & (F.col("revision_id") == request.revision_id))
    part = F.substring("text", request.offset + 1, size)
    row = own.select("relative", "sha", "kind", "level", "status", "historical", "text_sha", part.alias("text"), F.length("text").alias("total")).first()  # one page
    if row is None:
        raise ValueError("the revision is not among those that may be read")
    if request.offset < 0 or request.offset >= row.total:
        raise ValueError("the offset is behind the end of the text")
    end = request.offset + len(row.text)
    pinned.check()
    return {**row.asDict(), "start": request.offset, "end": end, "complete": end == row.total}, None if end == row.total else replace(request, offset=end)


def request_of(values: dict) -> Request:
    """A request from its fields, which must be exactly those of one."""
    if set(values) != set(asdict(Request("", "", ""))) or not isinstance(values["history"], bool) or not isinstance(values["offset"], int) or values["offset"] < 0:
        raise ValueError("not a request")
    return Request(**values)


_QUESTION, _REWRITES = "The tion of and?", ["Une de la", "with und der"]


def q_discover_request(spark: SparkSession, sf: str) -> DataFrame:
    """A release of all documents, two pages of candidates of a question with rewrites, and how the first of each page reads on."""
    docs, labels = (table(spark, sf, x) for x in ("documents", "labels"))
    root = scratch_path(spark, "discover")
    scan = build._scan(docs, labels, 1)
    build.build_release(spark, root, scan, spark.createDataFrame([], "relative string, fields map<string,string>, expected_sha string, request_id string, decided_at string"))
    first = discover(spark, root, _QUESTION, _REWRITES, limit=12)
    second = discover(spark, root, _QUESTION, _REWRITES, limit=12, offset=first.next_offset or 0, token=first.token)
    read = []
    for page in (first, second):
        request = requests(page)[0]
        while request:
            got, request = read_source(spark, root, request, 4000)
            read.append((got["relative"], got["text"]))
    whole = spark.createDataFrame(read, "relative string, piece string").groupBy("relative").agg(F.sum(F.length("piece")).alias("read"))
    pages = first.candidates.unionByName(second.candidates)
    return pages.join(whole, "relative", "left").select("rank", "relative", "score", "hits", "total", F.coalesce("read", F.lit(0)).alias("read"), F.lit(first.matched).cast("long").alias("matched"))


_ALLOWED = "allowed AS (SELECT * FROM (SELECT d.*, 'doc-' || substr(sha256(source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md'), 1, 12) AS key, source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' AS relative, row_number() OVER (PARTITION BY text ORDER BY source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md') AS r FROM documents d) WHERE r = 1 AND lang IN ('en', 'fr', 'de') AND " + build._SIZE_SQL + " >= 20 AND NOT " + build._PRIVATE_SQL + ")"
_ASKED = [["the", "tion", "of", "and"], ["une", "de", "la"], ["with", "und", "der"]]
_WIN = "win AS (SELECT doc_id, lang, s AS start, substr(text, CAST(s + 1 AS BIGINT), 1800) AS w FROM (SELECT key AS doc_id, lang, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 1560)) AS s FROM allowed))"
_DISCOVER_SQL = "WITH " + ", ".join([_ALLOWED, _WIN, lexical._TOKENS, *[lexical._sql_bm25(f"q{i}", q) for i, q in enumerate(_ASKED)], *[lexical._sql_rank(f"q{i}") for i in range(3)]]) + """, fused AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS hits FROM (SELECT * FROM q0r UNION ALL SELECT * FROM q1r UNION ALL SELECT * FROM q2r) GROUP BY doc_id),
page AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS matched FROM fused)
SELECT CAST(rank AS INTEGER) AS rank, relative, score, hits, length(text) AS total, CASE WHEN rank IN (1, 13) THEN length(text) ELSE 0 END AS read, matched FROM page JOIN allowed ON key = page.doc_id WHERE rank <= 24"""
QUERIES = {"discover_request": q_discover_request}
ORACLES = {"discover_request": _DISCOVER_SQL}
