"""Where a pattern matches in whole texts, with DataFrame functions only.

The pieces between the matches and the matches themselves give every position: a match
begins after all earlier pieces and matches. Positions count code points, ends are
exclusive, matches are leftmost and do not overlap. A span is a struct (start, end, value).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256
PIECE = 1024
LAST = (1 << 31) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _ints() -> Column:
    return F.array().cast("array<int>")


def _starts(steps: Column) -> Column:
    """Start of each match from an array of structs (gap, size).

    Running sums are taken in chunks, since a growing array is copied at every step.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.size(steps) - 1, F.lit(CHUNK)), lambda o: F.slice(steps, o + 1, CHUNK))
    zero = F.struct(F.lit(0).alias("at"), _ints().alias("out"))
    walk = lambda s, x: F.struct((s.at + x.gap + x.size).alias("at"), F.concat(s.out, F.array(s.at + x.gap)).alias("out"))
    inner = F.transform(chunks, lambda c: F.aggregate(c, zero, walk))
    add = lambda s, c: F.struct((s.at + c.at).alias("at"), F.concat(s.out, F.array(s.at)).alias("out"))

    def shifted(done: Column) -> Column:
        bases = F.aggregate(done, zero, add, lambda s: s.out)
        return F.flatten(F.zip_with(done, bases, lambda c, b: F.transform(c.out, lambda x: x + b)))

    return let(inner, shifted)


def _chunks(values: Column) -> Column:
    n = F.size(values)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(CHUNK)), lambda o: F.slice(values, o + 1, CHUNK))).otherwise(F.array(F.slice(values, 1, 0)))


def running_max(values: Column, start: int) -> Column:
    """For each of an array of ints the largest of those before it, ``start`` for the first.

    Taken in chunks, since a growing array is copied at every step.
    """
    zero = lambda: F.struct(F.lit(start).alias("most"), _ints().alias("out"))
    walk = lambda s, x: F.struct(F.greatest(s.most, x).alias("most"), F.concat(s.out, F.array(s.most)).alias("out"))
    inner = lambda chunks: F.transform(chunks, lambda c: F.aggregate(c, zero(), walk))

    def joined(done: Column) -> Column:
        # the same, chunk by chunk of chunks, for the largest of all earlier chunks
        tops = F.transform(done, lambda c: c.most)
        before = F.transform(_chunks(tops), lambda c: F.aggregate(c, zero(), walk))
        bases = let(before, lambda b: F.flatten(F.zip_with(b, F.aggregate(b, zero(), lambda s, c: F.struct(F.greatest(s.most, c.most).alias("most"), F.concat(s.out, F.array(s.most)).alias("out")), lambda s: s.out), lambda c, m: F.transform(c.out, lambda x: F.greatest(x, m)))))
        return F.flatten(F.zip_with(done, bases, lambda c, m: F.transform(c.out, lambda x: F.greatest(x, m))))

    return let(let(values, lambda v: inner(_chunks(v))), joined)


def free_of(spans: Column, taken: Column) -> Column:
    """The ``spans`` that overlap none of ``taken``, in their order; arrays of structs with start and end.

    One pass over both in the order of their starts: a span is free when all taken ones that
    begin before it have ended, and those that begin later begin after its end.
    """
    def sweep(x: Column) -> Column:
        own = F.transform(x.own, lambda s, i: F.struct(s.start.alias("start"), i.alias("at"), s.end.alias("end")))
        other = F.transform(x.other, lambda s: F.struct(s.start.alias("start"), F.lit(-1).alias("at"), s.end.alias("end")))

        def kept(ordered: Column) -> Column:
            ended = running_max(F.transform(ordered, lambda s: F.when(s.at < 0, s.end).otherwise(-1)), -1)
            coming = F.reverse(running_max(F.transform(F.reverse(ordered), lambda s: F.when(s.at < 0, -s.start).otherwise(-LAST)), -LAST))
            around = F.zip_with(ended, coming, lambda e, c: F.struct(e.alias("ended"), c.alias("coming")))
            judged = F.zip_with(ordered, around, lambda s, m: F.struct(s.at.alias("at"), (m.ended <= s.start).alias("after"), (-m.coming >= s.end).alias("before")))
            free = F.filter(judged, lambda j: (j.at >= 0) & j.after & j.before)
            return F.transform(F.array_sort(F.transform(free, lambda j: j.at)), lambda i: x.own[i])

        return let(F.array_sort(F.concat(own, other)), kept)

    both = F.struct(spans.alias("own"), taken.alias("other"))
    return F.when((F.size(spans) > 0) & (F.size(taken) > 0), let(both, sweep)).otherwise(spans)


def pieces_of(text: Column) -> Column:
    """The text cut into pieces of ``PIECE`` code points, for ``cut_out``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut_out(pieces: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to before ``end``; reads the pieces they are in, not all text before them."""
    first = F.floor(start / PIECE).cast("int")
    n = F.floor((end - 1) / PIECE).cast("int") - first + 1
    return F.when(end > start, F.substring(F.array_join(F.slice(pieces, first + 1, n), ""), start % PIECE + 1, end - start)).otherwise("")


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")


def regex_spans(text: Column, pattern: str, possible: Column | None = None) -> Column:
    """Spans of ``pattern`` in ``text``; where ``possible`` is false nothing is searched."""

    def positions(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.char_length)
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), F.char_length(m).alias("size")))
        starts = let(steps, _starts)
        span = lambda s, m: F.struct(s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("value"))
        return F.when(F.size(found) > 0, F.zip_with(starts, found, span)).otherwise(no_spans())

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), positions)
    return spans if possible is None else F.when(possible, spans).otherwise(no_spans())


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
