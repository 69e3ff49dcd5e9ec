"""Text functions as column expressions: tokens, windows, normal forms, number tokens."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

WINDOW, STRIDE = 1800, 1560
#: Runs of Han characters, or runs of other letters and digits.
RUNS = r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"


def join_han(text: Column) -> Column:
    """White space between Han characters is layout, not a word boundary."""
    return F.regexp_replace(text, r"(?<=\p{IsHan})\s+(?=\p{IsHan})", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; a run of Han characters becomes its overlapping pairs.

    Texts without any Han character, most of them, take one expression that runs as compiled code.
    """
    plain = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    runs = F.regexp_extract_all(F.lower(join_han(text)), F.lit(RUNS), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))
    pieces = F.flatten(F.transform(runs, lambda r: F.when(F.rlike(r, F.lit(r"^\p{IsHan}{2,}$")), pairs(r)).otherwise(F.array(r))))
    return F.when(F.rlike(text, F.lit(r"\p{IsHan}")), pieces).otherwise(plain)


def fixed_windows(docs: DataFrame, text: str = "text", size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """One row for each window of each text: start (0-based) and window; an empty or null text has one empty window."""
    body = F.coalesce(F.col(text), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(body) - 1, F.lit(0)), F.lit(stride))
    return docs.withColumn("start", F.explode(starts)).withColumn("window", body.substr(F.col("start") + 1, F.lit(size)))


#: Numbers that carry a unit, and the first and last character of the Han block that names may hold.
NUMBERS = r"\p{Nd}+(?:\.\p{Nd}+)?\s*%|\p{Nd}+\s*个?月|\p{Nd}+\s*周岁"
HAN_FIRST, HAN_LAST = "\u3400", "\u9fff"


def number_tokens(text: Column) -> Column:
    """Distinct percentages, months and ages without white space, sorted."""
    found = F.regexp_extract_all(text, F.lit("(?U)" + NUMBERS), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"(?U)\s+", ""))))


def _per_text(function):
    """A string function over Arrow batches, called once for each distinct text of a batch."""

    @arrow_udf("string")
    def apply(column: pa.Array) -> pa.Array:
        coded = column.dictionary_encode()
        own = pa.array([None if x is None else function(x) for x in coded.dictionary.to_pylist()], pa.string())
        return own.take(coded.indices)

    return apply


def _compatible(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def _folded(text: str) -> str:
    return "".join(c for c in _compatible(text).casefold() if c.isalnum() or HAN_FIRST <= c <= HAN_LAST)


def folded_case(text: Column) -> Column:
    """Upper and lower case made one, in full: a sharp s becomes two letters."""
    return _per_text(lambda x: x.lower() if x.isascii() else x.casefold())(text)


def compatible(text: Column) -> Column:
    """Compatibility forms become the characters they stand for: full-width letters, ligatures, circled digits."""
    return _per_text(_compatible)(text)


def normal(text: Column) -> Column:
    """The normal form of a name: compatibility forms and case folded in full, then letters, digits and Han only."""
    return _per_text(_folded)(text)


def slug(text: Column, most: int = 48, unnamed: str = "knowledge-base") -> Column:
    """A name for a folder: compatibility forms resolved, runs of other characters one hyphen, no mark at either end."""
    trimmed = F.regexp_replace(compatible(text), r"^[\p{Z}\t-\r\x1c-\x1f\x85]+|[\p{Z}\t-\r\x1c-\x1f\x85]+$", "")
    joined = F.regexp_replace(trimmed, r"[^\p{L}\p{N}_\u3400-\u9fff-]+", "-")
    cut = F.regexp_replace(joined, "^[-_]+|[-_]+$", "").substr(F.lit(1), F.lit(most))
    return F.when(cut == "", F.lit(unnamed)).otherwise(cut)


#: A wish for earlier versions, what rules it out, and how many characters before it are looked at.
HISTORY = "历史(?:版本|资料)?|旧版|上一版|更新前|新旧(?:对比|变化)|版本对比"
NO_HISTORY = "不要(?:使用|查询)?|不(?:要|使用|查)|排除|仅(?:用|查|看)?当前|只(?:用|查|看)?当前"
HISTORY_REACH = 12


def has_history_intent(text: Column) -> Column:
    """A question asks for earlier versions: its first such word decides, unless what stands just before rules it out."""
    before = F.right(F.regexp_extract(text, f"(?s)^(.*?)(?:{HISTORY})", 1), F.lit(HISTORY_REACH))
    return F.coalesce(F.rlike(text, F.lit(HISTORY)) & ~F.rlike(before, F.lit(NO_HISTORY)), F.lit(False))
