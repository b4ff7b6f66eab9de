"""Row-wise column expressions. All stay inside generated code; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that stands for "missing" in the name columns.
BLANK_TOKENS = (" ", "", "0", "_", "-")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log10_or_zero(c: Column | str) -> Column:
    """log10 of a positive number, otherwise 0."""
    c = _col(c)
    return F.when(c > 0, F.log10(c)).otherwise(F.lit(0.0))


def blank_to(c: Column | str, tokens: Sequence[str] = BLANK_TOKENS, label: str = "unknown") -> Column:
    """Replace junk tokens by ``label``."""
    c = _col(c)
    return F.when(c.isin(*tokens), F.lit(label)).otherwise(c)


def recode(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Rename or merge levels; a level outside the map, and null, stay as they are."""
    c = _col(c)
    if not mapping:
        return c
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def canonicalize(c: Column | str, rules: Sequence[tuple[str, str | None, str]]) -> Column:
    """Map free text to labels with ordered (include, exclude, label) patterns.

    Patterns are unanchored. Each rule sees the value left by the rules before it.
    """
    value = _col(c)
    for include, exclude, label in rules:
        hit = value.rlike(include)
        if exclude:
            hit = hit & ~value.rlike(exclude)
        value = F.when(hit, F.lit(label)).otherwise(value)
    return value


def replace_first(c: Column | str, pattern: str, replacement: str) -> Column:
    """Replace only the first match (``regexp_replace`` alone replaces every match).

    The text is cut once at the match and joined again, so the pattern is used as it is given,
    with its own flags and back-references. It must not match the empty text.
    """
    return F.array_join(F.split(_col(c), pattern, 2), replacement)


def round_half_even(c: Column | str, digits: int = 0) -> Column:
    """Round ties to the even digit."""
    return F.bround(_col(c), digits)


def concat_label(sep: str, *cols: Column | str) -> Column:
    return F.concat_ws(sep, *[_col(c).cast("string") for c in cols])


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(_col(a), _col(b))


def year_of(c: Column | str) -> Column:
    return F.year(_col(c))


def years_in_service(recorded: Column | str, built: Column | str, fill: float) -> Column:
    """Years between building and recording; an unknown (0) building year counts as ``fill``."""
    built = _col(built)
    return _col(recorded) - F.when(built == 0, F.lit(float(fill))).otherwise(built)


def nonzero_flag(c: Column | str) -> Column:
    return (_col(c) != 0).cast("int")


def collapse_target(c: Column | str, positives: Sequence[str], positive: str, negative: str) -> Column:
    """Merge the classes of a target into two."""
    c = _col(c)
    return F.when(c.isin(*positives), F.lit(positive)).when(c.isNotNull(), F.lit(negative))


def key_hash(key: Column | str, salt: str = "") -> Column:
    """Stable 32-bit hash of a key's text; the same in any engine that has md5."""
    text = _col(key).cast("string")
    if salt:
        text = F.concat(text, F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def fold_of(key: Column | str, k: int, salt: str = "") -> Column:
    """Fold number 0..k-1 from the row key alone: no sort, no random numbers, stable on retry."""
    return F.pmod(key_hash(key, salt), F.lit(k)).cast("int")
