"""Masking of secrets in parameters and free text.

All three maskers are built-in expressions (``transform_values``, ``rlike``,
``regexp_replace``), so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "DEFAULT_MASK_WORDS", "DEFAULT_KEY_PATTERNS", "TEXT_MASK_RULES", "MASK",
    "mask_params_by_words", "mask_params_by_regex", "mask_text", "mask_text_array",
    "params_from_json",
]

MASK = "***"

# Android runtime's default parameter-name words (substring test
# on the lower-cased name; the words themselves are not lower-cased).
DEFAULT_MASK_WORDS = ["password", "token", "pin", "secret", "cvv", "ssn"]

# JS runtime's default parameter-name patterns (case-insensitive find).
DEFAULT_KEY_PATTERNS = ["password", "token", "jwt", "api[_-]?key", "secret", "cvv", "ssn", "pin",
                        "creditcard"]

# Free-text secret shapes with the replacement that keeps the key,
# applied in this order (Java regex syntax).
TEXT_MASK_RULES = [
    (r"(?i)(password|passwd|token|jwt|api[_-]?key|secret|cvv|ssn|pin|auth)\s*([=:])\s*\S+", "$1$2***"),
    (r"(?i)(authorization|bearer)\s+=[A-Za-z0-9._~+/=-]*", "$1=***"),
    (r"(?i)(authorization|bearer)(\s+)[A-Za-z0-9._~+/-][A-Za-z0-9._~+/=-]*", "$1$2***"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "***"),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mask_params_by_words(params="params", words=None, fold_words: bool = False) -> Column:
    """A value becomes ``***`` when the lower-cased key contains any word.

    Words are used as given (a word with capitals never matches, as in the
    reference) unless ``fold_words``.  An empty list turns masking off.
    """
    words = DEFAULT_MASK_WORDS if words is None else list(words)
    p = _c(params)
    if not words:
        return p
    if fold_words:
        words = [w.lower() for w in words]
    wl = F.array(*[F.lit(w) for w in words])
    return F.transform_values(
        p, lambda k, v: F.when(F.exists(wl, lambda w: F.contains(F.lower(k), w)), F.lit(MASK)).otherwise(v))


def mask_params_by_regex(params="params", patterns=None) -> Column:
    """A value becomes ``***`` when any pattern is found in the key, ignoring case."""
    patterns = DEFAULT_KEY_PATTERNS if patterns is None else list(patterns)
    p = _c(params)
    if not patterns:
        return p
    rx = "(?i)(?:" + "|".join(f"(?:{x})" for x in patterns) + ")"
    return F.transform_values(p, lambda k, v: F.when(k.rlike(rx), F.lit(MASK)).otherwise(v))


def mask_text(text, rules=None) -> Column:
    """Replace secret shapes in free text, keeping the key part."""
    rules = TEXT_MASK_RULES if rules is None else rules
    out = _c(text)
    for pattern, repl in rules:
        out = F.regexp_replace(out, pattern, repl)
    return out


def mask_text_array(arr, rules=None) -> Column:
    """P14 over stack frames."""
    return F.transform(_c(arr), lambda s: mask_text(s, rules))


def params_from_json(text) -> Column:
    """JSON object text -> map<string,string>; strings as is, numbers and
    booleans as their literal text, nested values as JSON text, null as the
    text ``null``."""
    return F.transform_values(F.from_json(_c(text), "map<string,string>"),
                              lambda _, v: F.coalesce(v, F.lit("null")))
