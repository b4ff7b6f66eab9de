"""Secrets in whole texts, with DataFrame functions only.

Fixed patterns find assignments, access keys and long hexadecimal strings. Beyond them,
candidate strings without blanks are scanned with a sliding window: the Shannon entropy of
each window follows from the sum of c * log2(c) over its character counts, which are kept
while the window moves: a step takes one from the count of the character that leaves and adds
one to that of the character that enters. A candidate is read in chunks of characters, so its
scan takes time in proportion to its length. The threshold depends on the
character class (hexadecimal, letters of both cases with digits, of one case with digits,
letters alone). Placeholders, UUIDs and parts of addresses are on the allow-list and suppress
such a candidate; an address ends at white space, a quote, a comma, a semicolon or a bracket.
Spans of the fixed patterns are never suppressed. Random letters of one case are no more
uneven than long words and are found only where their entropy is above that of most words.

Defined cases: a null text is empty (and stays null when redacted); an empty text has no
spans; a text of any length is scanned and redacted whole, in time proportional to its length;
repeated rows are reported each; an empty table gives no rows; columns of the input pass
through, one with the name of the output is replaced, as is one named ``__text``, ``__base``
or ``__found``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import cut_out, free_of, let, listed, pieces_of, regex_spans, running_max

# What counts as a secret, in the order in which kinds are listed. Runs are
# matched possessively and from their first character, so a search takes linear time.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
}
KINDS = (*PATTERNS, "entropy")
ASSIGNED = 8

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: bits per character of the best window that make a candidate a secret
HEX_BITS, MIXED_BITS, ONE_CASE_BITS, LETTER_BITS = 3.0, 3.7, 3.6, 3.8
ALLOWED_WORDS = ("example", "sample", "placeholder", "dummy", "changeme", "redacted", "xxxxxx", "000000", "abcdef", "123456")
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
BEFORE = 200
APART = r"""[\s"'`,;<>()\[\]{}]"""


# c * log2(c) for every count a window can have
_WEIGHTS = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]
CHUNK = 512


def best_window_entropy(value: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy (bits per character) of any ``window`` characters in a row of ``value``, an ASCII text.

    The counts of a window are a text with one character for each of 128 codes, whose own code
    is the count; the state is that text and the sum of c * log2(c).
    """
    weights = F.array(*[F.lit(w) for w in _WEIGHTS])
    none = F.struct(F.lit("\0" * 128).alias("counts"), F.lit(0.0).alias("total"))
    count = lambda counts, code: F.ascii(F.substring(counts, code + 1, F.lit(1)))
    put = lambda counts, code, n: F.overlay(counts, F.chr(n), code + 1, F.lit(1))

    def moved(state: Column, code: Column, by: int) -> Column:
        change = lambda n: F.struct(put(state.counts, code, n + by).alias("counts"), (state.total - weights[n] + weights[n + by]).alias("total"))
        return let(count(state.counts, code), change)

    def slide(state: Column, step: Column) -> Column:
        after = let(moved(state, step.leaves, -1), lambda held: moved(held, step.enters, 1))
        return let(after, lambda a: F.struct(a.counts.alias("counts"), a.total.alias("total"), F.least(state.least, a.total).alias("least")))

    def least_of(codes: Column, start: Column) -> Column:
        """Least sum over the windows that begin at ``start`` and up to ``CHUNK`` places later."""
        first = F.aggregate(F.slice(codes, start + 1, window), none, lambda s, c: moved(s, c, 1))
        begun = let(first, lambda f: F.struct(f.counts.alias("counts"), f.total.alias("total"), f.total.alias("least")))
        room = F.least(F.lit(CHUNK), F.size(codes) - window - start)
        steps = F.zip_with(F.slice(codes, start + 1, room), F.slice(codes, start + window + 1, room), lambda a, b: F.struct(a.alias("leaves"), b.alias("enters")))
        return F.aggregate(steps, begun, slide, lambda s: s.least)

    def scan(codes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(codes) - window, F.lit(0)), F.lit(CHUNK))
        return F.array_min(F.transform(starts, lambda o: least_of(codes, o)))

    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), F.ascii)
    return F.lit(math.log2(window)) - let(codes, scan) / float(window)


def _secret_like(pieces: Column, span: Column) -> Column:
    value = span.value
    lowered = F.lower(value)
    is_hex = F.rlike(value, F.lit(r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$"))
    has_lower, has_upper, has_digit = (F.rlike(value, F.lit(c)) for c in ("[a-z]", "[A-Z]", "[0-9]"))
    before = cut_out(pieces, F.greatest(span.start - BEFORE, F.lit(0)), span.start)
    before = F.element_at(F.split(before, APART, -1), -1)
    allowed = F.rlike(value, F.lit(UUID)) | F.rlike(before, F.lit(r"://|@"))
    for word in ALLOWED_WORDS:
        allowed = allowed | F.contains(lowered, F.lit(word))
    bits = F.when(is_hex, HEX_BITS).when(~has_digit, LETTER_BITS).when(has_lower & has_upper, MIXED_BITS).otherwise(ONE_CASE_BITS)
    return (has_lower | has_upper) & ~allowed & let(value, lambda v: best_window_entropy(v) >= bits)


def _of_kind(spans: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(
        spans, lambda s: F.struct(s.start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s.end.alias("end"), s.value.alias("value"))
    )


def scan_secrets(docs: DataFrame, output: str = "secrets") -> DataFrame:
    """``docs`` with ``output``: array of (start, order, kind, end, value) by start, then kind."""
    text = F.col("__text")
    rows = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    assigned = F.filter(
        regex_spans(text, PATTERNS["assign"], F.rlike(text, F.lit("(?i:passw|secret|token|api_?key)"))),
        lambda s: F.char_length(F.regexp_extract(s.value, PATTERNS["assign"], 1)) >= ASSIGNED,
    )
    rows = rows.withColumn(
        "__base",
        F.concat(
            _of_kind(assigned, "assign"),
            _of_kind(regex_spans(text, PATTERNS["access"], F.contains(text, F.lit("AKIA"))), "access"),
            _of_kind(regex_spans(text, PATTERNS["hex"]), "hex"),
        ),
    )
    rows = rows.withColumn("__found", regex_spans(text, CANDIDATE))
    inputs = F.struct(pieces_of(text).alias("pieces"), free_of(F.col("__found"), F.col("__base")).alias("found"))
    more = let(inputs, lambda x: F.filter(x.found, lambda s: _secret_like(x.pieces, s)))
    more = F.when(F.size("__found") > 0, _of_kind(more, "entropy")).otherwise(F.slice("__base", 1, 0))
    return rows.withColumn(output, F.array_sort(F.concat("__base", more))).drop("__text", "__base", "__found")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and spans per document, the spans of the fixed patterns also as a digest."""
    found = scan_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s.kind != "entropy")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``, overlapping ones by one; n_chars follows if present."""
    found = scan_secrets(docs, "__secrets")

    def cut(x: Column) -> Column:
        before = running_max(F.transform(x.spans, lambda s: s.end), 0)
        parts = F.zip_with(x.spans, before, lambda s, at: F.when(s.start >= at, F.concat(cut_out(x.pieces, at, s.start), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(parts, ""), cut_out(x.pieces, F.array_max(F.transform(x.spans, lambda s: s.end)), x.n))

    inputs = F.struct(F.col("__secrets").alias("spans"), pieces_of(F.col("text")).alias("pieces"), F.char_length("text").alias("n"))
    text = F.when(F.size("__secrets") > 0, let(inputs, cut)).otherwise(F.col("text"))
    changed = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.size("__secrets") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)
