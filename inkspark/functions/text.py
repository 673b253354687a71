"""Column functions on note and chat text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Runs of characters other than space, tab, CR and LF; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]+"), F.lit(0)), F.array().cast("array<string>"))


def approx_tokens(text: Column) -> Column:
    """Words times 1.3, cut to a whole number; 0 for null and blank."""
    return F.floor(F.size(words(text)) * 13 / F.lit(10)).cast("long")


def batch_tokens(total_chars: Column) -> Column:
    """Characters of a batch by 3.5, cut to a whole number."""
    return F.floor(total_chars * 2 / F.lit(7)).cast("long")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def wikilinks(text: Column) -> Column:
    """Targets of [[target|alias]] in order, repeats kept; a #heading stays part of the target."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return F.coalesce(F.transform(raw, lambda x: F.trim(F.split(x, r"\|")[0])), F.array().cast("array<string>"))


def tags(text: Column, given: Column) -> Column:
    """#tag and #a/b of the text together with the given ones, distinct and sorted."""
    found = F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_/-]+)"), F.lit(1))
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(given, none), F.coalesce(found, none))
    return F.array_sort(F.array_distinct(F.filter(both, lambda x: x.isNotNull())))


def excerpt(text: Column, n: int = 200) -> Column:
    """The first n characters, always followed by three dots."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def short_excerpt(text: Column, n: int = 200) -> Column:
    """The text, cut after n characters with three dots only where it is longer."""
    return F.when(F.length(text) > n, excerpt(text, n)).otherwise(text)


def cache_key(text: Column) -> Column:
    return F.sha2(text, 256)


def contextual(context: Column, text: Column) -> Column:
    """A chunk behind the context that describes it."""
    return F.concat(context, F.lit("\n\n"), text)


def grade(reply: Column) -> Column:
    """correct, ambiguous or incorrect; a reply that names several counts as the worst, one that names none as ambiguous."""
    r = F.upper(reply)
    return F.when(r.contains("INCORRECT"), "incorrect").when(r.contains("AMBIGUOUS"), "ambiguous").when(r.contains("CORRECT"), "correct").otherwise("ambiguous")


def grade_rank(graded: Column) -> Column:
    return F.when(graded == "correct", 3).when(graded == "ambiguous", 2).otherwise(1)


def confidence(reply: Column) -> Column:
    """The number of the last CONFIDENCE line within 0 and 1; 0.5 without one."""
    found = F.regexp_extract_all(reply, F.lit(r"(?im)^[ \t]*CONFIDENCE:[ \t]*(-?[0-9.]+)"), F.lit(1))
    said = F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast("double"), F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), said))


def gaps(reply: Column) -> Column:
    """The text of the last GAPS line; null without one, and for none, no gaps and n/a."""
    found = F.regexp_extract_all(reply, F.lit(r"(?im)^[ \t]*GAPS:[ \t]*(.*)$"), F.lit(1))
    last = F.trim(F.try_element_at(found, F.lit(-1)))
    return F.when(F.lower(last).isin("none", "no gaps", "n/a", ""), None).otherwise(last)


def numbered_lines(reply: Column, most: int) -> Column:
    """Up to most lines that aren't blank, without a leading number such as 1. or 2)."""
    lines = F.filter(F.transform(F.split(reply, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\d+[.)]\s*", ""))), 1, most)


def variations(query: Column, reply: Column, most: int) -> Column:
    """The query and up to most - 1 variations; headings and bullets are left out."""
    lines = F.filter(numbered_lines(reply, 1000), lambda x: ~x.rlike(r"^[#*-]") & (x != query))
    return F.slice(F.array_distinct(F.concat(F.array(query), lines)), 1, most)


def verdict(reply: Column) -> Column:
    """False if the first line says INVALID, else true."""
    return ~F.upper(F.split(reply, r"\r?\n")[0]).contains("INVALID")


def read(reply: str, **parts: Callable[[Column], Column]) -> Row:
    """The parts, made of the column they are given, of one reply: what the loops use on the driver, by the same rules as whole tables."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return spark.createDataFrame([(reply,)], "reply string").select(*[make(F.col("reply")).alias(name) for name, make in parts.items()]).first()
