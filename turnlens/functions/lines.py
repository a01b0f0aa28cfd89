"""Cutting over-long lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space after the end of a sentence, or after a comma.
AFTER_SENTENCE, AFTER_COMMA = r"(?U)(?<=[.!?;])[\s\x1c-\x1f]+", r"(?U)(?<=,)[\s\x1c-\x1f]+"
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _slices(part: Column, limit: int) -> Column:
    """A text in slices of ``limit`` characters."""
    return F.regexp_extract_all(part, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0))


def _packed(pieces: Column, limit: int) -> Column:
    """Pieces joined by a space while they fit; an open text that is empty is taken over by the next piece."""
    none = F.array().cast("array<string>")

    def step(s, piece):
        both = F.concat(s["open"], F.lit(" "), piece)
        empty, fits = s["open"] == "", F.length(both) <= limit
        done = F.when(s["open"].isNull() | empty | fits, s["done"]).otherwise(F.array_append(s["done"], s["open"]))
        kept = F.when(s["open"].isNull() | empty | ~fits, piece).otherwise(F.regexp_replace(both, _EDGES, ""))
        return F.named_struct(F.lit("done"), done, F.lit("open"), kept)

    start = F.named_struct(F.lit("done"), none, F.lit("open"), F.lit(None).cast("string"))
    return F.aggregate(pieces, start, step, lambda s: F.when(F.coalesce(s["open"], F.lit("")) == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def pieces_of_line(line: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters of a line: it is cut after . ! ? ; else after commas, else anywhere, and
    small pieces are joined by a space again."""
    first = F.split(line, AFTER_SENTENCE, -1)
    parts = F.when(F.size(first) > 1, first).otherwise(F.split(line, AFTER_COMMA, -1))
    hard = F.flatten(F.transform(parts, lambda p: _slices(p, limit)))
    return F.when(F.length(line) <= limit, F.array(line)).when(F.size(parts) == 1, hard).otherwise(_packed(hard, limit))


def line_pieces(limit: int):
    """A function of an array of lines: the pieces of each, as an array of arrays."""
    return lambda lines: F.transform(lines, lambda line: pieces_of_line(line, limit))
