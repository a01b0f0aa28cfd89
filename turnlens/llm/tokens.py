"""Token counts (operator 10): offset-mapped attribution of tokens to sections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._text import text_slices
from .quality import encode, token_bytes

#: Who gets a token that crosses a boundary: the section of its first character, of its last, of most of its
#: characters (the earlier one on a tie), or every touched section by its share of the characters.
RULES = ("first", "last", "most", "share")


def token_spans(text: str, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of the tokens of a whole text.

    Byte-level tokens tile the UTF-8 bytes. A token owns the characters whose first byte it holds, so spans tile the
    characters; a token with only later bytes of a character has an empty span at that character's end."""
    ids = encode(vocabulary, text)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.cumsum(token_bytes(vocabulary)[0][ids]) if len(ids) else np.zeros(0, np.int64)
    first_bytes = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    starts = np.concatenate(([0], ends[:-1])) if len(ids) else ends
    return first_bytes[starts], first_bytes[ends]


def section_bounds(text: str) -> np.ndarray:
    """Starts of the sections: the text's start and the character after every newline that text follows."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    after = np.flatnonzero(codes == 10) + 1
    return np.concatenate(([0], after[after < len(codes)])).astype(np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, n_chars: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens by section, tokens that cross a boundary, by the section of their first character): a sorted interval
    join of token spans with section spans. Tokens with an empty span go to the section of the character before."""
    limits = np.append(bounds, max(n_chars, 1))
    empty = starts == ends
    head = np.searchsorted(bounds, np.where(empty, np.maximum(starts - 1, 0), starts), side="right") - 1
    tail = np.searchsorted(bounds, np.maximum(ends - 1, 0), side="right") - 1
    tail = np.maximum(np.where(empty, head, tail), head)
    crossing = tail > head
    n = len(bounds)
    crossed = np.bincount(head[crossing], minlength=n)
    if rule == "last":
        return np.bincount(tail, minlength=n).astype(float), crossed
    counts = np.bincount(head if rule == "first" else head[~crossing], minlength=n).astype(float)
    if rule in ("most", "share"):
        for s, e, a, b in zip(starts[crossing], ends[crossing], head[crossing], tail[crossing], strict=True):
            sections = np.arange(a, b + 1)
            parts = np.minimum(limits[sections + 1], e) - np.maximum(limits[sections], s)
            if rule == "share":
                counts[sections] += parts / (e - s)
            else:
                counts[sections[int(np.argmax(parts))]] += 1
    return counts, crossed


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", rule: str = "first") -> DataFrame:
    """One row per section of every document: key, section (ordinal), start_char, end_char, n_tokens, n_crossing.

    Each whole text is encoded once; sections are its lines, each with the newline that ends it. A null or empty
    text gives one empty section with no tokens. Token counts add up to the document's tokens under every rule.
    Repeated rows give repeated results. No shuffle: spans and sections of a document meet inside its own task.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType(source.schema.fields[:1] + StructType.fromDDL("section long, start_char long, end_char long, n_tokens double, n_crossing long").fields)

    def work(batches):
        for batch in batches:
            keys = batch.column(0)
            for first, last, buf, offs in text_slices(batch.column(1)):
                rows, columns = [], [[], [], [], [], []]
                for i in range(last - first):
                    whole = buf[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")
                    bounds = section_bounds(whole)
                    counts, crossed = attribute(*token_spans(whole, vocabulary), bounds, len(whole), rule)
                    rows.append(np.full(len(bounds), first + i))
                    for c, x in zip(columns, (np.arange(len(bounds)), bounds, np.append(bounds[1:], len(whole)), counts, crossed), strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(np.concatenate(rows))), *(pa.array(np.concatenate(c)) for c in columns)],
                    names=schema.names,
                )

    return source.mapInArrow(work, schema).withColumnRenamed("key", key)


def document_totals(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens, sections and crossing tokens of each document."""
    return sections.groupBy(key).agg(
        F.count("*").alias("n_sections"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_crossing").alias("n_crossing")
    )
