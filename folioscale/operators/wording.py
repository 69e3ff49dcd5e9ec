"""What texts say: numerals, markers, properties and topics of a quote, families of titles, byte ends, excerpts, strongest terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.session import table

#: Numerals and the digits they stand for, side by side.
NUMERALS, DIGITS = "零〇一二两三四五六七八九", "001223456789"
#: Words that ask for earlier versions, and for pages of navigation.
HISTORY_MARKERS = ["历史版本", "旧版", "老版本", "上一版", "此前版本", "更新前", "变更前", "新旧对比", "版本对比", "版本区别", "superseded", "previous version", "old version"]
NAVIGATION_MARKERS = ["来源导航", "资料导航", "知识库索引", "全库索引", "知识图谱", "图谱节点", "主题节点", "vault index", "source navigation"]
#: Words of a title that do not part one family of documents from another, removed in this order.
FAMILY_MARKERS = ["正式保险条款", "保险条款", "条款摘要", "条款", "产品说明书", "产品说明", "培训问答", "问答", "已改名", "新版", "新版本", "修订版", "修订"]
#: Patterns of what a quote may bear on, of its topics, of what it rules out and of a person's own account.
IRRELEVANT = "(?:不约定|未约定|不涉及|未涉及|不包含|未说明|不说明)(?:具体)?"
PROPERTIES = {
    "loan_term_months": "(?:贷款|借款).{0,24}(?:期限|个月)|(?:期限|个月).{0,24}(?:贷款|借款)",
    "loan_limit_percent": "(?:贷款|借款).{0,24}(?:金额|上限|%|百分)|(?:金额|上限|%|百分).{0,24}(?:贷款|借款)|现金价值.{0,16}(?:比例|%|百分|不得超过|不超过)|(?:比例|%|百分|不得超过|不超过).{0,16}现金价值",
    "loan_termination_condition": "(?:贷款|借款).{0,28}(?:中止|终止|效力)|(?:中止|终止|效力).{0,28}(?:贷款|借款)",
    "dividend_guaranteed": "(?:红利|分红).{0,16}(?:保证|不保证|零|固定|承诺|可能)|(?:保证|不保证|零|固定|承诺|可能).{0,16}(?:红利|分红)",
    "dividend_zero_possible": "(?:红利|分红).{0,16}(?:保证|不保证|零|固定|承诺|可能)|(?:保证|不保证|零|固定|承诺|可能).{0,16}(?:红利|分红)",
}
QUOTE_TOPICS = {"loan": "贷款|借款|现金价值", "dividend": "红利|分红", "insured_age": "投保年龄|被保险人年龄|周岁"}
PERSONAL = "我会|我通常|我的客户|我服务|本人(?:会|通常|曾|负责)|个人经历|服务流程"
#: Words of a request that frame it, scopes that it rules out, and lengths of the runs of Han characters that are its terms.
FRAMING = [
    "个人知识库", "知识库", "同主题", "历史口播", "历史文章", "业务案例", "个人内容", "个人表达",
    "产品资料", "业务资料", "个人资料", "完整历史文章", "完整作品", "我的", "结合", "参考", "使用",
    "整理", "一篇", "一段", "一条", "这篇", "口播", "文章", "资料", "内容", "案例", "生成", "写作",
]
RULED_OUT = ["(?:与|和|跟)[^，。！？；;\\n]*无关", "(?:不涉及|不讨论|不包含|不要使用|不参考|不使用)[^，。！？；;\\n]*"]
TERM_LEAST, TERM_MOST = 2, 8
#: Where a product's name ends in a title, what is no part of it, and where a text or a title names a version.
NAME_ENDS = "(?:正式)?保险条款|条款摘要|条款|产品说明书|产品说明|利益演示|培训问答\\d*|保单贷款问答\\d*|问答\\d*|测试材料"
NO_NAME = ["\\b[vV]\\s*\\d+(?:\\.\\d+)*\\b", "[（(](?:教学模拟|模拟|测试)[^）)]*[）)]?"]
YEAR = "(?:19|20)\\d{2}"
TEXT_VERSION, TITLE_VERSION = "(?:文档版本|版本|条款编号|备案编号)\\s*[：:]?\\s*([A-Za-z0-9_.-]{1,30})", "(?:^|[_-])[vV](\\d+(?:\\.\\d+)*)"
UNMARKED = "未标明"
#: Headings of an excerpt, and the room for them and the end.
HEADING, MOST_HEADINGS, END_ROOM, HEAD_LEAST = "^[一二三四五六七八九十0-9]+[、.．）)]", 24, 300, 800
#: Marks around what a person added to a page.
NOTES_START, NOTES_END = "<!-- llm-wiki:user-notes:start -->", "<!-- llm-wiki:user-notes:end -->"


def _digit(text: Column, other: int) -> Column:
    """The value of a single numeral; other for anything else."""
    return F.when(text.rlike(f"^[{NUMERALS}]$"), F.translate(text, NUMERALS, DIGITS).cast("int")).otherwise(other)


def _below_hundred(text: Column) -> Column:
    left, right = F.substring_index(text, "十", 1), F.substring(text, F.instr(text, "十") + 1, F.length(text))
    plain = F.translate(text, NUMERALS, DIGITS)
    return F.when(text.rlike("^[0-9]+$"), text.cast("long")).when(text.contains("十"), _digit(left, 1) * 10 + _digit(right, 0)).when(text.rlike(f"^[{NUMERALS}]+$"), plain.cast("long"))


def numeral(text: Column) -> Column:
    """The whole number that digits or Han numerals up to the hundreds stand for; null if they stand for none."""
    left, right = F.substring_index(text, "百", 1), F.substring(text, F.instr(text, "百") + 1, F.length(text))
    return F.when(text.contains("百"), _digit(left, 1) * 100 + F.coalesce(_below_hundred(right), F.lit(0))).otherwise(_below_hundred(text)).cast("long")


def percent_text(text: Column) -> Column:
    """A text without white space in which every spelled percentage is digits and a sign; those that are no number stay."""
    parts = F.split(F.regexp_replace(text, r"\s+", ""), "百分之")

    def rewritten(part: Column) -> Column:
        head = F.regexp_extract(part, f"^[{NUMERALS}十百0-9]+", 0)
        value = numeral(head)
        return F.when((head == "") | value.isNull(), F.concat(F.lit("百分之"), part)).otherwise(F.concat(value.cast("string"), F.lit("%"), F.substring(part, F.length(head) + 1, F.length(part))))

    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), rewritten), ""))


def holds_any(text: Column, markers: Sequence[str]) -> Column:
    """Whether a text holds one of the markers, whatever its case; not a null text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.greatest(*[low.contains(m) for m in markers])


def kept_for_question(question: Column, superseded: Column, navigation: Column) -> Column:
    """Whether a page answers a question: earlier versions and pages of navigation only if they are asked for."""
    return (~superseded | holds_any(question, HISTORY_MARKERS)) & (~navigation | holds_any(question, NAVIGATION_MARKERS))


def family(title: Column) -> Column:
    """What titles of one document's versions have in common."""
    value = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]", ""), r"v\d+$", "")
    for marker in FAMILY_MARKERS:
        value = F.replace(value, F.lit(marker), F.lit(""))
    return value


def quote_properties(quote: Column) -> Column:
    """Names of the properties that a quote may bear on, none if it says that it rules nothing."""
    named = F.array(*[F.when(quote.rlike(p), F.lit(name)) for name, p in PROPERTIES.items()])
    return F.when(quote.rlike(IRRELEVANT), F.array().cast("array<string>")).otherwise(F.filter(named, lambda x: x.isNotNull()))


def quote_topics(quote: Column) -> Column:
    return F.filter(F.array(*[F.when(quote.rlike(p), F.lit(name)) for name, p in QUOTE_TOPICS.items()]), lambda x: x.isNotNull())


def byte_suffix(text: Column, limit: int) -> Column:
    """struct<text, start>: the longest end of whole characters within so many bytes, and the byte it starts at."""
    data = F.encode(text, "UTF-8")
    start = F.greatest(F.lit(0), F.octet_length(data) - limit)
    whole = F.regexp_replace(F.hex(F.substring(data, start + 1, F.lit(limit))), "^(?:[89AB][0-9A-F])+", "")
    return F.struct(F.decode(F.unhex(whole), "UTF-8").alias("text"), (F.octet_length(data) - F.length(whole) / 2).cast("long").alias("start"))


def excerpt(text: Column, limit: int) -> Column:
    """The beginning of a text, its first headings and its end, within a limit; a text within the limit as it is."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    headings = F.array_join(F.slice(F.filter(lines, lambda x: x.startswith("#") | (F.length(x).between(2, 70) & x.rlike(HEADING))), 1, MOST_HEADINGS), "\n")
    head = F.greatest(F.lit(HEAD_LEAST), limit - F.least(F.length(headings) + 80, F.lit(limit // 3)) - END_ROOM)
    tail = F.least(F.lit(END_ROOM), F.greatest(F.lit(0), limit - head - F.length(headings) - 80))
    parts = F.concat(
        F.regexp_replace(F.substring(text, F.lit(1), head), r"\s+$", ""),
        F.when(headings != "", F.concat(F.lit("\n\n[文内标题]\n"), headings)).otherwise(""),
        F.when(tail > 0, F.concat(F.lit("\n\n[文末片段]\n"), F.regexp_replace(F.right(text, tail), r"^\s+", ""))).otherwise(""),
    )
    return F.when(F.length(text) <= limit, text).otherwise(F.substring(parts, 1, limit))


def strongest_term(text: Column, terms: dict[str, int]) -> Column:
    """struct<term, start> of the heaviest term in a text (equal weights: the longest), where it first stands; null without any."""
    low = F.lower(text)
    ranked = sorted(terms, key=lambda t: (-terms[t], -len(t)))
    return F.coalesce(*[F.when(low.contains(t), F.struct(F.lit(t).alias("term"), (F.instr(low, t) - 1).alias("start"))) for t in ranked])


def question_terms(question: Column) -> Column:
    """Sorted distinct terms of a request: words of three letters or more and runs of Han characters, without what frames it or is ruled out."""
    value = F.lower(F.coalesce(question, F.lit("")))
    for pattern in RULED_OUT:
        value = F.regexp_replace(value, pattern, " ")
    for word in sorted(FRAMING, key=len, reverse=True):
        value = F.replace(value, F.lit(word), F.lit(" "))
    spans = F.regexp_extract_all(value, F.lit("[㐀-鿿]+|[a-z][a-z0-9_-]+"), F.lit(0))

    def runs(span: Column) -> Column:
        sizes = F.sequence(F.lit(TERM_LEAST), F.least(F.lit(TERM_MOST), F.length(span)))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(span) - n + 1), lambda i: F.substring(span, i, n))))

    none = F.array().cast("array<string>")
    terms = F.transform(spans, lambda x: F.when(x.rlike("^[a-z]"), F.when(F.length(x) > 2, F.array(x)).otherwise(none)).when(F.length(x) >= TERM_LEAST, runs(x)).otherwise(none))
    return F.array_sort(F.array_distinct(F.flatten(terms)))


def product_metadata(title: Column, text: Column) -> Column:
    """struct<name, year, version, applies>: what a title and the whole text say of a product; a version is the text's own, else the title's."""
    name = F.element_at(F.split(title, NAME_ENDS, 2), 1)
    for pattern in NO_NAME:
        name = F.regexp_replace(name, pattern, "")
    name = F.regexp_replace(F.regexp_replace(name, "[_-]+", " "), r"^[ （()）-]+|[ （()）-]+$", "")
    name = F.when(name == "", title).otherwise(name)
    year = F.regexp_extract(F.concat(name, F.lit(" "), title), YEAR, 0)
    said, titled = F.regexp_extract(F.coalesce(text, F.lit("")), TEXT_VERSION, 1), F.regexp_extract(title, TITLE_VERSION, 1)
    version = F.when(said != "", said).when(titled != "", F.concat(F.lit("v"), titled)).otherwise(UNMARKED)
    return F.struct(name.alias("name"), year.alias("year"), version.alias("version"), F.when(year == "", UNMARKED).otherwise(year).alias("applies"))


def own_notes(page: Column) -> Column:
    """What a person wrote between the marks of a page, empty without both in order."""
    start, end = F.instr(page, NOTES_START), F.instr(page, NOTES_END)
    inner = F.substring(page, start + len(NOTES_START), end - start - len(NOTES_START))
    return F.when((start > 0) & (end > start), F.regexp_replace(inner, "^\n+|\n+$", "")).otherwise("")


def path_is_valid(path: Column) -> Column:
    """Whether a path is relative, in its plain form, and passes through nothing hidden or above."""
    return F.coalesce((path != "") & ~path.rlike(r"[\\:\x00]") & ~path.startswith("/") & ~path.rlike(r"(^|/)\.") & ~path.rlike("//|/$"), F.lit(False))


def _listed(place: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (place + 1).cast("int"))


def _said(column: str, sentences: list[str]) -> Column:
    return _listed(F.col(column) % len(sentences), sentences)


def q_percent_text(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_quantity").cast("int")
    spelled = F.concat(_listed(F.floor(n / 10), ["", "十", "二十", "三十", "四十", "五十"]), _listed(n % 10, ["", "一", "二", "三", "四", "五", "六", "七", "八", "九"]))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", percent_text(F.concat(F.lit("不超过 百分之"), spelled, F.lit("，另 百分之一百"), spelled, F.lit("与百分之多少"))).alias("plain"))


_QUESTIONS = ["旧版条款怎么说", "打开知识图谱", "保单贷款期限几个月", "Previous version of the plan", "来源导航与版本区别"]


def q_kept_for_question(spark: SparkSession, sf: str) -> DataFrame:
    kept = kept_for_question(_said("o_custkey", _QUESTIONS), F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "5-LOW")
    return table(spark, sf, "orders").select("o_orderkey", kept.alias("kept"))


def q_title_family(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat("p_name", _said("p_partkey", ["保险条款", " V12", "产品说明书（修订版）", "新版本 问答"]))
    return table(spark, sf, "part").groupBy(family(title).alias("family")).agg(F.count("*").alias("n"))


_QUOTES = ["保单贷款期限为6个月", "贷款金额不超过现金价值的80%", "红利不保证，可能为零", "本条未约定贷款期限", "被保险人年龄满18周岁", "借款未偿还时合同效力中止"]


def q_quote_scope(spark: SparkSession, sf: str) -> DataFrame:
    quote = _said("o_custkey", _QUOTES)
    return table(spark, sf, "orders").groupBy(F.array_join(quote_properties(quote), ",").alias("properties"), F.array_join(quote_topics(quote), ",").alias("topics")).agg(F.count("*").alias("n"))


def q_personal_account(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(_said("doc_id", ["我通常这样做。", "条款如下。", "本人曾服务。", "本人。"]), F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", said.rlike(PERSONAL).alias("personal"))


def q_byte_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", byte_suffix(F.col("text"), 97).alias("s")).select("doc_id", F.col("s.text").alias("suffix"), F.col("s.start").alias("start"))


def q_bounded_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("# 一\n2、second\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.sha2(excerpt(text, 1500), 256).alias("excerpt_sha"), (F.length(text) > 1500).alias("truncated"))


_TERMS = {"tion": 1000, "und": 900, "the": 500, "tre": 500, "an": 400}


def q_strongest_term(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", strongest_term(F.col("text"), _TERMS).alias("m")).select("doc_id", F.col("m.term").alias("term"), F.col("m.start").alias("start"))


_REQUESTS = ["结合我的知识库写作一篇保单贷款口播", "参考资料 about cash-value in PDF，不涉及红利，谈犹豫期", "与分红无关的年金领取", "文章", "Loan terms ok to 贷"]


def q_question_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.array_join(question_terms(_said("o_custkey", _REQUESTS)), ",").alias("terms")).agg(F.count("*").alias("n"))


_TITLES = ["金生2024保险条款", "red_plan v2.1（模拟件）", "条款摘要", "年金-V3 产品说明书2023", "ring"]


def q_product_metadata(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n文档版本：A-"), F.col("doc_id").cast("string"))).otherwise(""))
    docs = table(spark, sf, "documents").select("doc_id", product_metadata(F.concat(_said("doc_id", _TITLES), F.when(F.col("doc_id") % 2 == 0, "_v7").otherwise("")), text).alias("m"))
    return docs.select("doc_id", "m.*")


def q_own_notes(spark: SparkSession, sf: str) -> DataFrame:
    page = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("# page\n" + NOTES_START + "\n"), "text", F.lit("\n" + NOTES_END + "\n"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(NOTES_END), "text", F.lit(NOTES_START))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(own_notes(page), 256).alias("notes_sha"))


def q_path_validity(spark: SparkSession, sf: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    path = F.concat(_said("page_id", ["", "/", "a/../", "./", "a/.b/", "a//", "c:"]), plain)
    return table(spark, sf, "pages").select("page_id", path.alias("path"), path_is_valid(path).alias("valid"))


def _any_sql(text: str, markers: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{m}')" for m in markers) + ")"


def _named_sql(text: str, patterns: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{p}') THEN '{name}' END" for name, p in patterns.items()) + "], lambda x: x IS NOT NULL)"


_FAMILY_SQL = "regexp_replace(regexp_replace(lower(t), '[^\\p{L}\\p{N}]', '', 'g'), 'v\\d+$', '')"
for _marker in FAMILY_MARKERS:
    _FAMILY_SQL = f"replace({_FAMILY_SQL}, '{_marker}', '')"

_REQUEST_SQL = "lower(q)"
for _pattern in RULED_OUT:
    _REQUEST_SQL = f"regexp_replace({_REQUEST_SQL}, '{_pattern}', ' ', 'g')"
for _word in sorted(FRAMING, key=len, reverse=True):
    _REQUEST_SQL = f"replace({_REQUEST_SQL}, '{_word}', ' ')"

QUERIES = {
    "percent_text": q_percent_text,
    "kept_for_question": q_kept_for_question,
    "title_family": q_title_family,
    "quote_scope": q_quote_scope,
    "personal_account": q_personal_account,
    "byte_suffix": q_byte_suffix,
    "bounded_excerpt": q_bounded_excerpt,
    "strongest_term": q_strongest_term,
    "own_notes": q_own_notes,
    "product_metadata": q_product_metadata,
    "question_terms": q_question_terms,
    "path_validity": q_path_validity,
}
ORACLES = {
    "percent_text": "SELECT l_orderkey, l_linenumber, '不超过' || CAST(n AS VARCHAR) || '%，另' || CAST(100 + n AS VARCHAR) || '%与百分之多少' AS plain FROM (SELECT *, CAST(trunc(l_quantity) AS BIGINT) AS n FROM lineitem)",
    "kept_for_question": f"SELECT o_orderkey, (o_orderstatus <> 'F' OR {_any_sql('q', HISTORY_MARKERS)}) AND (o_orderpriority <> '5-LOW' OR {_any_sql('q', NAVIGATION_MARKERS)}) AS kept FROM (SELECT *, {_QUESTIONS}[o_custkey % 5 + 1] AS q FROM orders)",
    "title_family": f"SELECT {_FAMILY_SQL} AS family, count(*) AS n FROM (SELECT p_name || ['保险条款', ' V12', '产品说明书（修订版）', '新版本 问答'][p_partkey % 4 + 1] AS t FROM part) GROUP BY 1",
    "quote_scope": f"SELECT CASE WHEN regexp_matches(q, '{IRRELEVANT}') THEN '' ELSE array_to_string({_named_sql('q', PROPERTIES)}, ',') END AS properties, array_to_string({_named_sql('q', QUOTE_TOPICS)}, ',') AS topics, count(*) AS n FROM (SELECT {_QUOTES}[o_custkey % 6 + 1] AS q FROM orders) GROUP BY 1, 2",
    "personal_account": f"SELECT doc_id, doc_id % 4 IN (0, 2) OR regexp_matches(coalesce(text, ''), '{PERSONAL}') AS personal FROM documents",
    "byte_suffix": "WITH b AS (SELECT doc_id, octet_length(encode(text)) AS n, regexp_replace(substr(hex(encode(text)), 2 * greatest(0, octet_length(encode(text)) - 97) + 1), '^(?:[89AB][0-9A-F])+', '') AS h FROM documents) SELECT doc_id, decode(unhex(h)) AS suffix, CAST(n - length(h) // 2 AS BIGINT) AS start FROM b",
    "bounded_excerpt": f"WITH t AS (SELECT doc_id, '# 一' || chr(10) || '2、second' || chr(10) || coalesce(text, '') AS t FROM documents), h AS (SELECT *, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x LIKE '#%' OR (length(x) BETWEEN 2 AND 70 AND regexp_matches(x, '{HEADING}')))[1:24], chr(10)) AS h FROM t), b AS (SELECT *, greatest(800, 1500 - least(length(h) + 80, 500) - 300) AS head FROM h), c AS (SELECT *, least(300, greatest(0, 1500 - head - length(h) - 80)) AS tail FROM b) SELECT doc_id, length(t) > 1500 AS truncated, sha256(CASE WHEN length(t) <= 1500 THEN t ELSE substr(regexp_replace(substr(t, 1, head), '\\s+$', '') || CASE WHEN h <> '' THEN chr(10) || chr(10) || '[文内标题]' || chr(10) || h ELSE '' END || CASE WHEN tail > 0 THEN chr(10) || chr(10) || '[文末片段]' || chr(10) || regexp_replace(right(t, tail), '^\\s+', '') ELSE '' END, 1, 1500) END) AS excerpt_sha FROM c",
    "strongest_term": "WITH m AS (SELECT doc_id, lower(text) AS low, unnest(['tion', 'und', 'the', 'tre', 'an']) AS term, unnest([1, 2, 3, 4, 5]) AS place FROM documents), f AS (SELECT doc_id, arg_min(term, place) AS term, arg_min(instr(low, term) - 1, place) AS start FROM m WHERE contains(low, term) GROUP BY 1) SELECT doc_id, term, CAST(start AS INTEGER) AS start FROM documents LEFT JOIN f USING (doc_id)",
    "own_notes": "SELECT conv_id, turn, sha256(CASE WHEN turn % 3 = 0 THEN regexp_replace(text, '^\\n+|\\n+$', '', 'g') ELSE '' END) AS notes_sha FROM conversations",
    "question_terms": f"WITH q AS (SELECT {_REQUESTS}[o_custkey % 5 + 1] AS q, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT q, n, unnest(regexp_extract_all({_REQUEST_SQL}, '[㐀-鿿]+|[a-z][a-z0-9_-]+')) AS x FROM q), r AS (SELECT q, CASE WHEN x[1] BETWEEN 'a' AND 'z' THEN CASE WHEN length(x) > 2 THEN [x] ELSE [] END ELSE flatten(list_transform(range(2, least(8, length(x)) + 1), lambda k: list_transform(range(1, length(x) - k + 2), lambda i: substr(x, i, k)))) END AS t FROM x), d AS (SELECT q, array_to_string(list_sort(list_distinct(flatten(list(t)))), ',') AS terms FROM r GROUP BY 1) SELECT coalesce(terms, '') AS terms, CAST(sum(n) AS BIGINT) AS n FROM q LEFT JOIN d USING (q) GROUP BY 1",
    "product_metadata": f"WITH t AS (SELECT doc_id, {_TITLES}[doc_id % 5 + 1] || CASE WHEN doc_id % 2 = 0 THEN '_v7' ELSE '' END AS t, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '文档版本：A-' || CAST(doc_id AS VARCHAR) ELSE '' END AS body FROM documents), a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_split_to_array(t, '{NAME_ENDS}')[1], '{NO_NAME[0]}', '', 'g'), '{NO_NAME[1]}', '', 'g'), '[_-]+', ' ', 'g'), '^[ （()）-]+|[ （()）-]+$', '', 'g') AS raw FROM t), b AS (SELECT *, CASE WHEN raw = '' THEN t ELSE raw END AS name FROM a), c AS (SELECT *, regexp_extract(name || ' ' || t, '{YEAR}') AS year, regexp_extract(body, '{TEXT_VERSION}', 1) AS said, regexp_extract(t, '{TITLE_VERSION}', 1) AS titled FROM b) SELECT doc_id, name, year, CASE WHEN said <> '' THEN said WHEN titled <> '' THEN 'v' || titled ELSE '{UNMARKED}' END AS version, CASE WHEN year = '' THEN '{UNMARKED}' ELSE year END AS applies FROM c",
    "path_validity": "WITH p AS (SELECT page_id, ['', '/', 'a/../', './', 'a/.b/', 'a//', 'c:'][page_id % 7 + 1] || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages) SELECT page_id, path, path <> '' AND NOT contains(path, '\\') AND NOT contains(path, ':') AND NOT starts_with(path, '/') AND NOT regexp_matches(path, '(^|/)\\.') AND NOT contains(path, '//') AND NOT ends_with(path, '/') AS valid FROM p",
}
