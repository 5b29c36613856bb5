"""Text normalisation and tokenisation as built-in column expressions (no Python UDFs)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: these must equal the published behaviour exactly -----------------------
# Whitespace characters removed by a Unicode-aware strip.
WHITESPACE = "".join(
    map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
)
LEADING_TIME = r"^\s*\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?\s*"
IDENTIFIERS = (
    (r"\bsupi-\d+\b", "supi_id"),
    (r"\bguti-[0-9a-f]+\b", "guti_id"),
    (r"\bses-\d+\b", "session_id"),
    (r"\bgnb-\d+\b", "gnb_id"),
    (r"\bcell-\d+\b", "cell_id"),
    (r"\bnf-\d+\b", "nf_instance_id"),
    (r"\bpol-\d+\b", "policy_id"),
    (r"\bsec-\d+\b", "security_context_id"),
    (r"\bueg-\d+\b", "ue_group_id"),
    (r"\bsst-\d+-sd-[0-9a-f]+\b", "slice_id"),
)
PRIVATE_ADDRESS = (r"\b(?:10|172|192)\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b", "ip_address")
NUMBER = (r"\b\d+(?:\.\d+)?\b", "num_value")
WORD = r"\b\w\w+\b"
ALPHA_START_WORD = r"[A-Za-z][A-Za-z0-9_-]*"
LABEL_WORDS = r"(?i)\b(?:normal|abnormal)\b"
EVENT_SEPARATOR = " [EVENT] "
# -------------------------------------------------------------------------------------------

_UNICODE = "(?U)"


def _literal_first(pattern: str) -> str:
    """The same matches, with the boundary check behind the first literal or digit.

    A pattern that starts with `\\b` is tried at every character; one that starts with a literal
    lets the matcher skip ahead.
    """
    head = re.match(r"\\b([a-z]+-|\\d)", pattern)
    if head is None:
        return pattern
    first, rest = head[1], pattern[head.end() :]
    if first == r"\d":
        rest = r"\d*" + rest.removeprefix("+")
    return rf"{first}(?<=\b{first}){rest}"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def as_string(value: Column) -> Column:
    """Null becomes '', everything else its stripped string form."""
    return strip(F.coalesce(value.cast("string"), F.lit("")))


def is_blank(value: Column) -> Column:
    return value.isNull() | (strip(value.cast("string")) == "")


def clean_log_text(value: Column) -> Column:
    """Mask identifiers, addresses and numbers, keep words, collapse the rest to single spaces.

    The ten identifier rules run only on texts that hold one of their prefixes. Symbols and odd
    whitespace become spaces first and only runs of spaces are rewritten after that, so an
    ordinary single space between words is never a match.
    """
    lowered = F.lower(F.regexp_replace(value.cast("string"), _UNICODE + LEADING_TIME, ""))
    masked = lowered
    for pattern, replacement in IDENTIFIERS:
        masked = F.regexp_replace(masked, _UNICODE + _literal_first(pattern), replacement)
    prefixes = [re.match(r"\\b([a-z]+-)", pattern)[1] for pattern, _ in IDENTIFIERS]
    may_hold = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(prefix)) for prefix in prefixes])
    text = F.when(may_hold, masked).otherwise(lowered)
    for pattern, replacement in (PRIVATE_ADDRESS, NUMBER):
        text = F.regexp_replace(text, _UNICODE + _literal_first(pattern), replacement)
    # No capital is left, so `\w` is a-z, 0-9 and _; as a class of ranges it is tested several times slower.
    spaced = F.regexp_replace(F.regexp_replace(text, r"[^\w\- ]+", " "), " {2,}", " ")
    return F.trim(F.translate(spaced, "-", "_"))


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda token: token != "")


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(_UNICODE + WORD), F.lit(0))


def alpha_token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ALPHA_START_WORD))


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by a space. Give it a plain column: `tokens` is referred to several times."""
    length = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), length), F.slice(tokens, F.lit(2), length), lambda a, b: F.concat_ws(" ", a, b)
    )


def has_label_word(text: Column) -> Column:
    return text.rlike(LABEL_WORDS)


def template_hash(text: Column, prefix: str = "GENERATED-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 16))


def contains_literal(text: Column, needle: str) -> Column:
    """Case-insensitive substring search without pattern syntax."""
    return F.contains(F.lower(text), F.lower(F.lit(needle)))


def clip(text: Column, longest: int = 200) -> Column:
    """The text for a table cell: '' for null, cut with an ellipsis beyond `longest` characters."""
    shown = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(shown) > longest, F.concat(F.left(shown, F.lit(longest)), F.lit("…"))).otherwise(shown)


def prettified(name: Column) -> Column:
    """A stored name for display, with blanks for underscores."""
    return F.translate(F.coalesce(name.cast("string"), F.lit("")), "_", " ")
