"""Column builders on text. All stay inside generated code; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First words of command lines.
COMMANDS = ("set", "show", "delete", "edit", "commit", "request", "clear")


def stripped(text: Column) -> Column:
    """Text without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Non-blank lines, stripped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), stripped), lambda x: x != "")


def slug(text: Column) -> Column:
    """Lower case, every run of other than a-z and 0-9 one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def bounded_slug(text: Column, size: int = 60) -> Column:
    """A slug of at most ``size`` characters, cut at a hyphen where there is one."""
    full = slug(text)
    head = F.substring(full, 1, size)
    whole = F.substring(full, size + 1, 1).isin("-", "")
    cut = F.when(F.locate("-", head) > 0, F.regexp_replace(head, "-[^-]*$", "")).otherwise(head)
    return F.when((F.length(full) <= size) | whole, F.regexp_replace(head, "-+$", "")).otherwise(cut)


def heading_slug(text: Column) -> Column:
    """Anchor of a heading: lower case, letters, digits, blanks, hyphens and underscores only, blanks as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(text)), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-")


def signal(text: Column) -> Column:
    """Lower case with runs of separators as one blank."""
    return stripped(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def words(text: Column) -> Column:
    """Runs of Unicode letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def ascii_tokens(text: Column) -> Column:
    """Tokens of the ASCII parity mode: punctuation becomes blanks first, then runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by one blank, in order."""
    last = F.size(tokens) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def solid_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s+", ""))


def is_structured(line: Column) -> Column:
    """A command, a table row, or a line with a gap of two blanks or more."""
    first = F.lower(F.regexp_replace(F.regexp_extract(line, r"^(\S+)", 1), "^[`|]+|[`|]+$", ""))
    return first.isin(*COMMANDS) | line.startswith("|") | line.rlike(r"\s{2,}\S")


def camel_to_snake(name: Column) -> Column:
    """fooBarHTTPCode -> foo_bar_http_code."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def cell(text: Column) -> Column:
    """Text for one Markdown table cell."""
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"\s*\n\s*", " ")


def version_numbers(text: Column) -> Column:
    """Greatest version in a text as an array of ints; arrays compare by position. Null where there is none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\d+(?:\.\d+)+)"), 1)
    parsed = F.transform(found, lambda v: F.transform(F.split(v, r"\."), lambda x: x.try_cast("int")))
    return F.array_max(parsed)


def family_key(title: Column) -> Column:
    """Slug of a title without its version."""
    return slug(F.regexp_replace(F.lower(title), r"[,]?\s*\b(?:release|version|rev|v)?\s*\d+(?:\.[0-9x]+)+(?:r\d+)?\b", " "))


def document_key(path: Column) -> Column:
    """Twelve digits of the path's SHA-1 and the last 200 characters of its slug."""
    s = slug(path)
    digest = F.substring(F.sha1(path), 1, 12)
    return F.when(s != "", F.concat_ws("-", digest, F.substring(s, -200, 200))).otherwise(digest)


def age_in_days(then: Column, now: Column) -> Column:
    """Whole 24-hour units passed."""
    return F.floor((now.cast("double") - then.cast("double")) / 86400)


def token_cost(text: Column) -> Column:
    """A token for every four characters begun."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)


def control_positions(text: Column) -> Column:
    """Zero-based positions of control characters other than tab, line feed and carriage return."""
    control = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + 1).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(p))).alias("out"))
    found = F.aggregate(F.split(text, control), start, step, lambda a: F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1))
    return F.when(text.rlike(control), found).otherwise(F.array().cast("array<int>"))


def page_bounds(page_range: Column) -> Column:
    """Lowest and highest page of a range in any notation; null where it names none."""
    n = F.transform(F.slice(F.regexp_extract_all(F.coalesce(page_range, F.lit("")), F.lit(r"(\d{1,6})"), 1), 1, 2), lambda x: x.cast("int"))
    return F.when(F.size(n) > 0, F.struct(F.array_min(n).alias("first"), F.array_max(n).alias("last")))
