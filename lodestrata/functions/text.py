"""Text functions as column expressions, for markdown documents, queries and tags.

Null texts give null unless stated; no function but packed() leaves the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of secrets, replaced in this order.
SECRETS = (
    r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\b(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{16,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"(?i)\b(api[_-]?key|secret|token|password|passwd|authorization|bearer)\b\s*[:=]\s*\S+",
)
#: Words that begin the heading of a plan, and marks of a plan's path.
PLAN_HEADING = r"(?i)^#+\s*(plan|todo|draft|wip|brouillon)\b"
PLAN_PATH = r"(PLAN[_-]|_PLAN\.md$|^plans/|DRAFT|WIP)"
#: Front-matter keys that name an author, first match first.
AUTHOR_KEYS = ("agent", "author", "generator", "created_by")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def present(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n", "\n")


def front_matter(c: Column) -> Column:
    """The block between a first line --- and the next; empty if there is none."""
    return F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)


def body(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\A---\n.*?\n---(\n|\z)", "")


def unquoted(c: Column) -> Column:
    return F.regexp_replace(strip(c), "^[\"']+|[\"']+$", "")


def front_matter_value(c: Column, key: str) -> Column:
    """The unquoted value of a key in the front matter; null if it is missing or empty."""
    return present(unquoted(F.regexp_extract(front_matter(c), rf"(?m)^{key}:[ \t]*([^\n]*)", 1)))


def slug(c: Column) -> Column:
    """Lower-cased runs of [a-z0-9] joined by hyphens; null if there are none."""
    return present(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""))


def contains_literal(c: Column, part: Column) -> Column:
    """Whether part occurs in c, whatever the case and without wildcards."""
    return F.contains(F.lower(c), F.lower(part))


def document_title(c: Column) -> Column:
    """A first-level heading in the first 2000 characters, else any heading there, else the front matter's title, else the first line that is not blank, at most 120 characters of it, else 'Untitled'."""
    text = unix_lines(c)
    head = F.substring(body(text), 1, 2000)
    first = F.substring(strip(F.regexp_extract(body(text), r"(?m)^[^\S\n]*(\S[^\n]*)", 1)), 1, 120)
    return F.coalesce(present(strip(F.regexp_extract(head, r"(?m)^#[ \t]+([^\n]+)", 1))), present(strip(F.regexp_extract(head, r"(?m)^#{1,6}[ \t]+([^\n]+)", 1))), front_matter_value(text, "title"), present(first), F.lit("Untitled"))


def name_title(path: Column) -> Column:
    """The file's name without .md or .mdx, with blanks for underscores and hyphens and every run of letters capitalised."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.mdx?$", ""), "[_-]", " ")
    runs = F.regexp_extract_all(F.lower(name), F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1000))), "")


def author(c: Column) -> Column:
    return F.coalesce(*[front_matter_value(unix_lines(c), key) for key in AUTHOR_KEYS])


def looks_like_plan(c: Column) -> Column:
    """Whether a heading among the first five lines after the front matter that are not blank begins like a plan's."""
    lines = F.filter(F.split(body(unix_lines(c)), "\n"), lambda x: strip(x) != "")
    return F.exists(F.slice(lines, 1, 5), lambda x: x.rlike(PLAN_HEADING))


def plan_path(path: Column) -> Column:
    return path.rlike(PLAN_PATH)


def redacted(c: Column) -> Column:
    for pattern in SECRETS:
        c = F.regexp_replace(c, pattern, "[redacted]")
    return c


def without_code(c: Column, by: str) -> Column:
    return F.regexp_replace(c, r"(?s)```.*?```", by)


def snippet(c: Column, n: int = 160, scan: int = 20_000) -> Column:
    """A plain preview of n characters from the first scan ones, with … where it was cut; null as empty."""
    text = unix_lines(F.substring(F.coalesce(c, F.lit("")), 1, scan))
    text = without_code(F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", ""), " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?m)^#+\s*", ""), "[`*_>]", "")
    text = strip(F.regexp_replace(text, r"\s+", " "))
    return F.concat(F.substring(text, 1, n), F.when(F.char_length(text) > n, "…").otherwise(""))


def first_words(c: Column, n: int = 50, mark: str = "…") -> Column:
    """The first n words without code blocks and heading marks, with a mark where words were left out."""
    text = F.regexp_replace(without_code(unix_lines(c), ""), r"(?m)^#+\s+", "")
    words = F.filter(F.split(strip(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")
    return F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) > n, mark).otherwise(""))


def highlighted(c: Column, terms: list[str]) -> Column:
    """HTML-escaped text with the terms, longest first and in any case, in <mark>."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    terms = sorted((t for t in terms if t), key=lambda t: (-len(t), t))
    return F.regexp_replace(c, "(?i)(" + "|".join(terms) + ")", '<mark class="hl">$1</mark>') if terms else c


def query_terms(c: Column, most: int = 24) -> Column:
    """The first runs of two or more of [a-z0-9] in the lower-cased text; null as none."""
    return F.slice(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0)), 1, most)


def cache_key(c: Column, summary: Column) -> Column:
    """The query trimmed, lower-cased and with single blanks, with the flag behind a bar."""
    return F.concat(F.regexp_replace(F.lower(strip(c)), r"\s+", " "), F.lit("|"), F.when(summary, "true").otherwise("false"))


def tag_name(c: Column) -> Column:
    """Lower-cased, without blanks and slashes around it; null if nothing is left."""
    return present(F.lower(F.regexp_replace(strip(c), "^/+|/+$", "")))


def tag_list(c: Column) -> Column:
    """The items of a comma-separated list that are not blank."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda t: t != "")


def fresh_label(days: Column) -> Column:
    d = lambda n: F.floor(n).cast("string")
    return F.when(days < 1, "fresh").when(days < 7, F.concat(F.lit("fresh "), d(days), F.lit("d"))).when(days < 30, F.concat(d(days), F.lit("d"))).when(days < 365, F.concat(d(days / 7), F.lit("w"))).otherwise(F.concat(d(days / 365), F.lit("y")))


def relative_time(seconds: Column) -> Column:
    d = lambda n: F.floor(n).cast("string")
    return F.when(seconds < 60, F.concat(d(seconds), F.lit("s ago"))).when(seconds < 3600, F.concat(d(seconds / 60), F.lit("m ago"))).when(seconds < 86400, F.concat(d(seconds / 3600), F.lit("h ago"))).otherwise(F.concat(d(seconds / 86400), F.lit("d ago")))


def short_number(n: Column) -> Column:
    """Whole below 1000, then one place of thousands (k) or millions (M), rounded down."""
    place = lambda by, unit: F.concat((F.floor(n / (by / 10)) / 10).cast("decimal(20,1)").cast("string"), F.lit(unit))
    return F.when(n < 1000, n.cast("long").cast("string")).when(n < 1_000_000, place(1000, "k")).otherwise(place(1_000_000, "M"))


def header_name(c: Column, most: int) -> Column:
    """Letters, digits, '.', '_' and '-' of a header, at most so many; 'unknown' if there are none."""
    return F.coalesce(present(F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}._-]", ""), 1, most)), F.lit("unknown"))


def probe_line(c: Column) -> Column:
    """The first stripped line of more than 40 characters that does not begin like markup, at most 200 of them; null if there is none."""
    lines = F.filter(F.transform(F.split(unix_lines(c), "\n"), strip), lambda x: (F.char_length(x) > 40) & ~x.rlike(r"^[#*|`-]"))
    return F.substring(F.try_element_at(lines, F.lit(1)), 1, 200)


def version_parts(c: Column) -> Column:
    """The numbers of a version as an array, compared place by place."""
    return F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))


def palette_place(c: Column, colours: int) -> Column:
    """The sum of the code points modulo the number of colours."""
    points = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.pmod(F.aggregate(points, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(colours))


def polyline(values: Column, width: int = 100, height: int = 30, pad: int = 3) -> Column:
    """The points of a line through an array of numbers, scaled to a box, "x,y" with a place each and blanks between; null for no numbers or none above 0."""
    most, n = F.array_max(values), F.size(values)
    place = lambda x: F.bround(x, 1).cast("decimal(10,1)").cast("string")
    across = lambda i: F.when(n > 1, F.lit(float(pad)) + i * F.lit(width - 2.0 * pad) / (n - 1)).otherwise(F.lit(pad + (width - 2.0 * pad) / 2))
    points = F.transform(values, lambda v, i: F.concat(place(across(i)), F.lit(","), place(F.lit(height - float(pad)) - v / most * F.lit(height - 2.0 * pad))))
    return F.when((n > 0) & (most > 0), F.array_join(points, " "))


def packed(c: Column, most: int) -> Column:
    """Paragraphs packed greedily into pieces of at most so many tokens; a paragraph over the limit stays whole, alone; null for null.

    Packing has no relational form, so it is an Arrow pass over each batch, in
    time that grows with the text and not with its square.
    """
    blank, ends = re.compile(r"\n\s*\n", re.ASCII), " \t\n\x0b\x0c\r"
    size = lambda s: max(1, len(s) // 4) if s else 0

    def pieces(text: str) -> list[str]:
        text = text.strip(ends)
        if size(text) <= most:
            return [text] if text else []
        out: list[list[str]] = []
        room = -1
        for paragraph in blank.split(text):
            if room < size(paragraph):
                out.append([])
                room = most
            out[-1].append(paragraph)
            room -= size(paragraph)
        return [p for p in ("\n\n".join(parts).strip(ends) for parts in out) if p]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(pieces, na_action="ignore")

    return run(c)
