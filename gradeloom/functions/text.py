"""Text expressions shared by the corpus jobs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gradeloom import fixed as V

NUMBER = r"[0-9]+"


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; lambdas would repeat it per step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_all(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(V.ALL_SPACES))


def collapse(text: Column) -> Column:
    return trim_all(F.regexp_replace(text, rf"{V.WS}+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, rf"{V.WS}+", "")


def clean_line(raw: Column) -> Column:
    """One source line: blanks collapsed; addresses, bare numbers and page headers blanked."""
    line = trim_all(F.regexp_replace(F.translate(raw, "\u00a0", " "), "[ \t]+", " "))
    noise = line.rlike(V.URL_LINE) | line.rlike(V.BARE_NUMBER_LINE) | line.rlike(V.PAGE_HEADER_LINE)
    return F.when(noise, F.lit("")).otherwise(line)


def first_int(text: Column) -> Column:
    """First run of digits as a number, null when there is none."""
    return F.nullif(
        F.regexp_extract(text, NUMBER, 0), F.lit("")).cast("bigint")


def needs_ocr(page: Column) -> Column:
    """Page text too short, too unreadable or too broken to use."""
    def verdict(body: Column) -> Column:
        n = F.length(body)
        readable = n - F.length(F.regexp_replace(body, r"[\p{L}\p{N}\p{P}\p{S}]", ""))
        broken = n - F.length(F.translate(body, "\ufffd\u25a1", ""))
        return (n < 55) | (readable / n < 0.78) | (broken / n > 0.16)
    return bind(compact(page), verdict)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it."""
    return text.str.normalize("NFKC")


def search_form(text: Column, unicode_fold: bool = True) -> Column:
    """Lower-cased, blank-collapsed text.  ASCII-only data can skip the Python fold."""
    folded = nfkc(text) if unicode_fold else text
    return collapse(F.lower(folded))


def query_form(query: str) -> str:
    """The same normal form for a literal query on the driver."""
    return " ".join(unicodedata.normalize("NFKC", query).lower().split())


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(query_form(query).split(" "))) if query_form(query) else []


def highlight(text: Column, query: str) -> Column:
    """Wrap every term of a literal query, longest first, in <mark>."""
    terms = sorted(query_terms(query), key=lambda t: -len(t))
    if not terms:
        return text
    pattern = "(?iu)(" + "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", t) for t in terms) + ")"
    return F.regexp_replace(text, pattern, "<mark>$1</mark>")


def note_tags(note: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(note, F.lit(r"#([\p{L}\p{N}_-]{1,24})"), F.lit(1)))


def note_source(note: Column, fallback: Column) -> Column:
    found = trim_all(F.regexp_extract(note, rf"(?m)^>{V.WS}*来源[：:]{V.WS}*(.+)$", 1))
    return F.when(found != "", found).otherwise(fallback)


def note_summary(note: Column) -> Column:
    text = F.regexp_replace(note, rf"(?m)^#{{1,6}}{V.WS}+", "")
    text = F.regexp_replace(text, rf"(?m)^>{V.WS}*(?:来源|标签|参考框架|AI整理)[：:].*$", "")
    text = F.regexp_replace(text, rf"(?m)^[-*]{V.WS}+", "")
    text = F.regexp_replace(text, "[*_`]", "")
    return collapse(text)


def _note_base(note: Column, stem: Column, source: Column) -> Column:
    trimmed = trim_all(note)
    return F.when(trimmed != "", trimmed).otherwise(
        F.concat(F.lit("# "), stem, F.lit("\n\n> 来源："), source))


def append_tag(note: Column, tag: Column, stem: Column, source: Column) -> Column:
    """Add a tag line once."""
    clean = F.substring(F.regexp_replace(F.regexp_replace(trim_all(tag), "^#+", ""),
                                         r"[^\p{L}\p{N}_-]", ""), 1, 24)
    skip = (clean == "") | F.array_contains(note_tags(note), clean)
    added = F.concat(_note_base(note, stem, source), F.lit("\n\n> 标签：#"), clean, F.lit("\n"))
    return F.when(skip, note).otherwise(added)


def append_block(note: Column, heading: Column, content: Column, stem: Column, source: Column) -> Column:
    """Add a generated block unless the note already holds it."""
    body = trim_all(content)
    base = _note_base(note, stem, source)
    block = F.concat(F.lit("## AI 整理 · "), heading, F.lit("\n> 来源："), source,
                     F.lit("\n> 参考框架：第十版 人卫教材（请以教材原文核对）\n\n"), body)
    return (F.when(body == "", note).when(F.contains(base, block), note)
            .otherwise(F.concat(base, F.lit("\n\n"), block, F.lit("\n"))))


def blocked_term(text: Column, terms: list[str] | None = None) -> Column:
    """First listed term found in the blank-free lower-cased text, else null."""
    body = F.lower(compact(text))
    out = F.lit(None).cast("string")
    for term in reversed(terms if terms is not None else V.BLOCKED_TERMS):
        out = F.when(F.contains(body, F.lit(term)), F.lit(term)).otherwise(out)
    return out


def redact_secrets(text: Column, limit: int | None = None) -> Column:
    masked = F.regexp_replace(text, rf"(?i)([?&](?:key|api_key|token)=)(?:(?!&){V.NON_WS})+",
                              "$1" + V.HIDDEN_TEXT.replace("$", "\\$"))
    masked = F.regexp_replace(masked, r"(?<![A-Za-z0-9_])(?:sk|key)-[A-Za-z0-9_-]{8,}(?![A-Za-z0-9_])",
                              V.HIDDEN_TEXT)
    return masked if limit is None else F.substring(masked, 1, limit)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([A-Za-z]+(?:['’-][A-Za-z]+)?)"), F.lit(1))


def word_count(text: Column) -> Column:
    body = trim_all(text)
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, rf"{V.WS}+")))


def safe_file_name(name: Column, limit: int, default: str) -> Column:
    cut = F.substring(F.regexp_replace(name, r'[\\/:*?"<>|]', "-"), 1, limit)
    return F.when(cut == "", F.lit(default)).otherwise(cut)


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(doc|docx|pdf)\z", "")


def client_key(forwarded: Column, real_ip: Column) -> Column:
    first = trim_all(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(real_ip, F.lit("")), F.lit("unknown"))


def group_rule_number(keywords: Column) -> Column:
    """Number of the first matching group rule; the number of rules when none matches."""
    out = F.lit(len(V.GROUP_RULES))
    for number, (_, pattern) in reversed(list(enumerate(V.GROUP_RULES))):
        out = F.when(keywords.rlike(pattern), F.lit(number)).otherwise(out)
    return out


def group_name(name: Column) -> Column:
    return collapse(F.coalesce(name, F.lit("")))


def blank_segments(passage: Column, numbers: list[str] | None = None) -> Column:
    """Passage cut at ``[[n]]`` tokens; odd elements are the blanks.

    Without canonical tokens the listed numbers, longest first, are the blanks.
    """
    canonical = F.regexp_replace(passage, r"\[\[([0-9]{1,3})\]\]", "\u0001[[$1]]\u0001")
    if not numbers:
        return F.split(canonical, "\u0001")
    listed = "|".join(sorted(numbers, key=lambda n: -int(n)))
    only = F.regexp_replace(passage, rf"\[\[({listed})\]\]", "\u0001[[$1]]\u0001")
    bare = F.regexp_replace(passage, rf"(?<![A-Za-z0-9_])({listed})(?![A-Za-z0-9_])", "\u0001$1\u0001")
    has = passage.rlike(r"\[\[[0-9]{1,3}\]\]")
    return F.split(F.when(has, only).otherwise(bare), "\u0001")
