"""Scalar text functions as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Superscript digits and signs, and the plain characters that they stand for.
SUPERSCRIPTS, PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-"
DASHES = "[‐-―−]"


def expand_numbers(marker: Column, widest: int = 500) -> Column:
    """The numbers of a citation marker, ``[2, 5–7; 9]`` as [2, 5, 6, 7, 9]; order kept, each once.

    A reversed or too wide range, or any part that is no number or range, makes the whole marker empty. An unclosed
    fragment such as ``[1,`` counts for what it holds.
    """
    plain = F.regexp_replace(F.translate(marker, SUPERSCRIPTS, PLAIN), DASHES, "-")
    inner = F.trim(F.regexp_replace(plain, r"[\[\]()]", ""))
    parts = F.filter(F.transform(F.split(inner, r"\s*[,;]\s*"), lambda p: F.trim(p)), lambda p: p != "")
    good = F.forall(parts, lambda p: p.rlike(r"^\d{1,9}(\s*-\s*\d{1,9})?$"))

    def ends(p: Column) -> tuple[Column, Column]:
        lo = F.regexp_extract(p, r"^(\d+)", 1).cast("int")
        hi = F.regexp_extract(p, r"-\s*(\d+)$", 1)
        return lo, F.when(hi == "", lo).otherwise(hi.cast("int"))

    sane = F.forall(parts, lambda p: (ends(p)[1] >= ends(p)[0]) & (ends(p)[1] - ends(p)[0] <= widest))
    spread = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(*ends(p)))))
    empty = F.array().cast("array<int>")
    return F.when(F.size(parts) == 0, empty).when(~good, empty).when(sane, spread).otherwise(empty)


def marker_style(marker: Column) -> Column:
    """Numeric, author_year or unknown."""
    return (
        F.when(F.size(expand_numbers(marker)) > 0, "numeric")
        .when(marker.rlike(r"(?U)\p{L}.*\b(1[5-9]|20)\d{2}[a-z]?\b"), "author_year")
        .otherwise("unknown")
    )


def alias_pattern(name: str) -> str:
    """a regular expression for a name: spaces, hyphens, slashes and dots between letters may vary."""
    words = [w for w in re.split(r"[\s\-‐-―/]+", name.strip()) if w]
    if len(words) == 1 and words[0].isupper() and words[0].isalpha():
        body = r"\.?\s?".join(map(re.escape, words[0])) + r"\.?"
    else:
        body = r"[\s\-‐-―/]+".join(map(re.escape, words))
    return rf"(?iU)(?<!\w){body}(?!\w)"


def any_alias(names: list[str]) -> str:
    """The alternation of all names, the longest first."""
    return "|".join(f"(?:{alias_pattern(n)})" for n in sorted(set(names), key=lambda n: (-len(n), n)))


def url_key(url: Column) -> Column:
    """a URL without scheme, www., spaces and closing punctuation, lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(url, r"\s+", "")), r"^https?://", ""), r"^www\.", "")
    return F.regexp_replace(bare, r"[/.,);]+$", "")


def in_domain(host: Column, domain: str) -> Column:
    """whether a host is a domain or below it; null hosts are not."""
    return F.coalesce((host == domain) | host.endswith(f".{domain}"), F.lit(False))


def doi_key(value: Column) -> Column:
    """a DOI without resolver or label, lower-cased; null where it is none."""
    bare = F.lower(F.trim(value))
    bare = F.regexp_replace(F.regexp_replace(bare, r"^https?://(dx\.)?doi\.org/", ""), r"^doi:\s*", "")
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def content_id(kind: str, *parts: Column) -> Column:
    """``kind_`` and 20 hexadecimal digits of a hash of the parts; null and empty parts differ."""
    marked = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("")) for p in parts]
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat_ws("\x1f", *marked), 256), 1, 20))


def display_id(prefix: str, n: Column, width: int) -> Column:
    """F32: a zero-padded number; wider ones are not cut."""
    digits = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def word_list(text: Column) -> Column:
    """the words of a text, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def match_spans(text: Column, pattern: str) -> Column:
    """the non-empty matches of a pattern as array<struct<start, end, match>>, in code points from 0.

    Matches and the pieces between them come from two built-in functions; offsets are running sums of their lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.split(text, pattern, -1)
    before = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(
        F.arrays_zip(found.alias("match"), F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0))).alias("k")),
        lambda z: F.struct(
            (before(pieces, z["k"] + 1) + before(found, z["k"])).alias("start"),
            (before(pieces, z["k"] + 1) + before(found, z["k"] + 1)).alias("end"),
            z["match"].alias("match"),
        ),
    )


def around(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """P10: the text of a span and what stands around it; offsets from 0, the end exclusive."""
    lo = F.greatest(start - before, F.lit(0))
    return F.substring(text, (lo + 1).cast("int"), (end + after - lo).cast("int"))


def sentences(text: Column) -> Column:
    """sentences, split after closing punctuation before a capital."""
    return F.split(text, r"(?<=[.!?])\s+(?=\p{Lu})")


#: Section parts by title, in the order in which they are tried.
PARTS = (
    ("abstract", r"abstract|summary"),
    ("introduction", r"introduction|background"),
    ("methods", r"method|material|data"),
    ("results", r"result|finding"),
    ("discussion", r"discussion|limitation"),
    ("conclusion", r"conclusion|outlook"),
    ("references", r"^\W*(references|bibliography|literature cited)\W*$"),
)


def section_part(title: Column) -> Column:
    """the part of a paper that a section title names; the first pattern that matches counts."""
    low = F.lower(title)
    out = F.when(low.isNull(), "other")
    for part, pattern in PARTS:
        out = out.when(low.rlike(pattern), part)
    return out.otherwise("other")


def is_reference_heading(text: Column) -> Column:
    """whether a line is the heading of a bibliography."""
    return F.coalesce(F.lower(F.trim(text)).rlike(r"^[\d.\s]*(references|bibliography|literature cited|works cited)\s*:?$"), F.lit(False))


def collection_tier(role: Column, matched: Column, structure: Column) -> Column:
    """1 matched, 2 sole author, 3 joint, compound or uncertain, 0 publisher and all others."""
    return (
        F.when(matched, 1)
        .when(role == "publisher", 0)
        .when((role == "author") & (structure == "sole"), 2)
        .when((role == "author") & structure.isin("joint", "compound", "uncertain"), 3)
        .otherwise(0)
    )


def redacted(value: Column, secrets: list[str]) -> Column:
    """a text with every secret replaced."""
    for secret in sorted(filter(None, secrets), key=len, reverse=True):
        value = F.replace(value, F.lit(secret), F.lit("[redacted]"))
    return value


def cell_text(value: Column) -> Column:
    """K6: control characters, but for tab and line ends, as visible escapes' placeholder."""
    return F.regexp_replace(value, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "�")
