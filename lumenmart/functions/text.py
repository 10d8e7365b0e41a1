"""Text columns: normalization, URL cleaning, personal data, match positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Query parameters that only track a click.
TRACKING_PARAMETERS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "tracking",
)
# Personal-data patterns in the order they are removed.
PRIVATE_PATTERNS = (
    ("email", r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("phone", r"(?U)(?<!\w)(?:\+?\d[\s().-]*){8,15}(?!\w)"),
    ("card", r"(?U)\b(?:\d[ -]*?){13,19}\b"),
    ("credential", r"(?iU)\b(?:password|passwd|api[_ -]?key|token)\s*[:=]\s*\S+"),
    ("address", r"(?iU)\b(?:via|viale|piazza|corso)\s+[A-Za-zÀ-ÿ.' -]{2,40}\s+\d{1,4}\b"),
)
# Patterns that may not appear in stored reasons.
REJECTED_PATTERNS = (
    ("email address", r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"),
    ("telephone number", r"(?U)(?<!\w)(?:\+?\d[\s().-]*){8,15}(?!\w)"),
    ("payment-card-like value", r"(?U)(?<!\d)(?:\d[ -]*?){13,19}(?!\d)"),
    ("precise street address", r"(?iU)\b(?:via|viale|piazza|corso|street|st\.|road|rd\.)\s+[A-Za-zÀ-ÿ' -]+\s+\d{1,5}\b"),
    ("credential or token", r"(?iU)\b(?:api[_ -]?key|token|password|passwd|secret)\s*[:=]\s*\S+"),
)
REMOVED = "[removed]"
# Letters with marks and their plain forms.
_MARKED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöōőřśšşťùúûüūůűýÿžźż"
_PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiinnnooooooorssstuuuuuuuyyzzz"
# Words that never identify a product.
IGNORED_WORDS = (
    "a", "an", "and", "body", "camera", "compatible", "con", "corpo", "f", "for", "il", "la",
    "lens", "mm", "mount", "obiettivo", "the", "with", "zoom",
)


def folded(text: Column) -> Column:
    """Lower case with the German sharp s written out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_alias(text: Column) -> Column:
    """Trimmed, folded, single-spaced."""
    return folded(F.regexp_replace(F.trim(text), r"\s+", " "))


def plain_words(text: Column) -> Column:
    """Folded words of letters and digits without marks, joined by single spaces."""
    unmarked = F.translate(F.regexp_replace(folded(text), r"\p{M}+", ""), _MARKED, _PLAIN)
    return F.trim(F.regexp_replace(unmarked, r"[^\p{L}\p{N}]+", " "))


def compact(text: Column) -> Column:
    """Only the ASCII letters and digits, folded."""
    return F.regexp_replace(folded(text), "[^a-z0-9]+", "")


def meaningful_words(text: Column) -> Column:
    """Words longer than one letter outside the ignored list, in order."""
    return F.filter(
        F.split(plain_words(text), " "), lambda word: (F.length(word) > 1) & ~word.isin(*IGNORED_WORDS)
    )


def digest(*texts: Column) -> Column:
    """One key for several texts, none of them null; lengths keep apart what only joins to the same characters."""
    return F.sha2(F.concat_ws(" ", *[F.length(text).cast("string") for text in texts], *texts), 256)


def distinct_folded(values: Column) -> Column:
    """First spelling of each value, ignoring case, in order of appearance."""
    return F.filter(values, lambda value, position: F.array_position(
        F.transform(values, folded), folded(value)) == position + 1)


def url_allowed(url: Column) -> Column:
    """Absolute http(s) address without embedded credentials."""
    return url.rlike(r"^(?i:https?)://[^/?#@]+([/?#]|$)")


def canonical_url(url: Column) -> Column:
    """Drop tracking parameters and the fragment; null when not an allowed address."""
    without_fragment = F.substring_index(url, "#", 1)
    base = F.substring_index(without_fragment, "?", 1)
    query = F.when(
        F.instr(without_fragment, "?") > 0,
        F.substr(without_fragment, F.length(base) + 2, F.length(without_fragment)),
    )
    kept = F.filter(
        F.split(query, "&"),
        lambda pair: (pair != "") & ~F.lower(F.substring_index(pair, "=", 1)).isin(*TRACKING_PARAMETERS),
    )
    suffix = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url_allowed(url), F.concat(base, suffix))


def redact(text: Column) -> Column:
    """Text with every kind of personal data replaced, in the fixed order; most texts hold none of the signs any kind needs."""
    signs = F.contains(text, F.lit("@")) | F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")) | text.rlike(r"(?U)\d")
    cleaned = text
    for _, pattern in PRIVATE_PATTERNS:
        cleaned = F.regexp_replace(cleaned, pattern, F.lit(REMOVED))
    return F.when(signs, cleaned).otherwise(text)


def private_kinds(text: Column) -> Column:
    """Labels of the rejected private patterns found in a text."""
    return F.array_compact(F.array(*[
        F.when(text.rlike(pattern), F.lit(label)) for label, pattern in REJECTED_PATTERNS
    ]))


def matches_with_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,found,part>> of every match of a pattern.

    Positions follow from the pieces between matches, so no per-row code runs.
    The array is short (matches only), the text is read twice.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    lengths = F.transform(found, F.length)
    total = lambda values, n: F.aggregate(F.slice(values, F.lit(1), n), F.lit(0), lambda a, b: a + b)
    return F.transform(found, lambda value, i: F.struct(
        (total(pieces, i + 1) + total(lengths, i)).alias("start"),
        (total(pieces, i + 1) + total(lengths, i + 1)).alias("end"),
        value.alias("found"),
        F.get(part, i).alias("part"),
    ))


def any_of(text: Column, patterns: Sequence[str]) -> Column:
    flag = F.lit(False)
    for pattern in patterns:
        flag = flag | text.rlike(pattern)
    return flag


def feed_price(text: Column, markers: Sequence[str], decimal: str = ".", thousands: str = ",") -> Column:
    """The one bounded number of a text that names its currency, else null."""
    named = F.lit(False)
    for marker in markers:
        named = named | F.contains(folded(text), F.lit(marker.lower()))
    tokens = F.regexp_extract_all(text, F.lit(r"\d[\d., ]{0,18}\d|\d"), F.lit(0))
    number = F.replace(F.get(tokens, F.lit(0)), F.lit(" "), F.lit(""))
    if thousands:
        number = F.replace(number, F.lit(thousands), F.lit(""))
    if decimal and decimal != ".":
        number = F.replace(number, F.lit(decimal), F.lit("."))
    value = number.try_cast("double")
    return F.when(named & (F.size(tokens) == 1) & (value >= 0), value)
