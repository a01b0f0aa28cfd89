"""Quality rules (operator 2): counting rules and tokeniser fertility.

A public byte-level vocabulary is used as a measuring rod: ordinary prose needs few tokens for its characters, mixes
many different tokens and rarely splits a character into bytes; junk does not. Bands differ by language, and by
script where the language is unknown.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._text import SLICE, shingle_hashes, text_slices, word_hashes, word_spans

#: The pre-tokenisation pattern that the byte-level vocabularies were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rejection bands by language, then by script: least and most characters per token, most byte-fallback share, least
#: entropy (bits) of the token distribution relative to its possible maximum. The least characters per token of a
#: language lie halfway between clean and symbol-ridden text, as measured on 6,000 labelled documents that pass the
#: base rules (least of those labelled good; most of those with a symbol for every two words or more): en 2.33 and
#: 2.01, de 2.52 and 1.96, fr 2.12 and 1.83, es 2.30 and 1.85. The other limits are wide: they reject text of
#: other kinds (raw bytes, one token over and over), of which the sample has none.
BANDS = {
    "en": (2.15, 9.0, 0.05, 0.45),
    "de": (2.20, 9.0, 0.08, 0.45),
    "fr": (1.95, 9.0, 0.10, 0.45),
    "es": (2.05, 9.0, 0.10, 0.45),
    "latin": (1.15, 10.0, 0.15, 0.40),
    "greek": (0.60, 8.0, 0.60, 0.40),
    "cyrillic": (0.60, 8.0, 0.60, 0.40),
    "arabic": (0.50, 8.0, 0.70, 0.40),
    "cjk": (0.25, 4.0, 0.95, 0.35),
    "other": (0.25, 10.0, 0.95, 0.35),
}
_SCRIPTS = (("greek", 0x370, 0x400), ("cyrillic", 0x400, 0x530), ("arabic", 0x600, 0x780), ("cjk", 0x3040, 0xD7B0))
_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, byte_fallback_share double, token_entropy double, script string"
)


@lru_cache(maxsize=4)
def encoder(path: str):
    """The vocabulary at ``path`` (ranks in base64 lines), one per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("fertility", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """By token id: length in bytes, and whether the token alone is not valid UTF-8 (a byte fallback)."""
    enc = encoder(path)
    lengths, partial = np.zeros(enc.n_vocab, np.int64), np.zeros(enc.n_vocab, bool)
    for token in enc.token_byte_values():
        i = enc.encode_single_token(token)
        lengths[i] = len(token)
        try:
            token.decode()
        except UnicodeDecodeError:
            partial[i] = True
    return lengths, partial


def encode(path: str, text: str) -> np.ndarray:
    """Token ids of a whole text. White space of 4096 and more characters is cut out and encoded as the one piece that
    the pattern makes of it, since the pattern engine cannot walk back over very long runs."""
    enc, parts, at = encoder(path), [], 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))  # the last one belongs to the next word
        parts += [enc.encode_ordinary(text[at : run.start()]), enc._encode_single_piece(text[run.start() : end])]
        at = end
    parts.append(enc.encode_ordinary(text[at:] if at else text))
    return np.concatenate([np.asarray(p, np.int64) for p in parts])


def _script(text: str) -> str:
    """The script of most non-ASCII letters, latin if ASCII and Latin letters prevail."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = codes[(codes >= 0x41) & ~((codes >= 0x5B) & (codes <= 0x60)) & ~((codes >= 0x7B) & (codes < 0xC0))]
    if not len(letters):
        return "other"
    counts = {"latin": int((letters < 0x250).sum())}
    counts |= {name: int(((letters >= low) & (letters < high)).sum()) for name, low, high in _SCRIPTS}
    name, most = max(counts.items(), key=lambda x: x[1])
    return name if 2 * most >= len(letters) else "other"


def _fertility(path: str, text: str) -> tuple:
    ids = encode(path, text)
    if not len(ids):
        return 0, 0.0, 0.0, 0.0, "other"
    share = np.bincount(ids)
    share = share[share > 0] / len(ids)
    entropy = abs(float(-(share * np.log2(share)).sum()))
    fallback = float(token_bytes(path)[1][ids].mean())
    return len(ids), len(text) / len(ids), fallback, entropy, _script(text)


def _repeat_words(words: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    windows = shingle_hashes(words, 3)
    if len(windows) < 2:
        return 0
    ordered = np.sort(windows)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def _dup_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def measures(column: pa.Array, vocabulary: str) -> list[tuple]:
    """The rule inputs of every text of a batch, in order (see ``SCHEMA``)."""
    out = []
    for _first, _last, buf, offs in text_slices(column, SLICE):
        starts, ends = word_spans(buf, offs)
        hashes = word_hashes(buf, starts, ends, fold_case=False)
        cut = np.searchsorted(starts, offs)
        inside = ((buf & 0xC0) != 0x80) & ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
        chars = np.concatenate(([0], np.cumsum(inside)))
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[buf])))
        for i in range(len(offs) - 1):
            low, high = offs[i], offs[i + 1]
            data = buf[low:high].tobytes()
            words = hashes[cut[i] : cut[i + 1]]
            out.append(
                (len(words), int(chars[high] - chars[low]), int(symbols[high] - symbols[low]), _dup_lines(data), _repeat_words(words))
                + _fertility(vocabulary, data.decode("utf-8", "replace"))
            )
    return out


def quality_rules(docs: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", bands: dict = BANDS) -> DataFrame:
    """``docs`` with rule inputs, base_failed, fertility_failed, reason and kept; rows, order and other columns stay.

    Base rules: under 50 words, or more than half of the words in 3-word windows that repeat in the text. Fertility
    rules: characters per token outside the band of the language (of the script where the language has no band), too
    many byte-fallback tokens, or a token entropy under the band's share of the most that this many tokens could have
    (log2 of the smaller of token count and 2048). Null and empty texts have no words and fail the base rules. Columns of ``docs`` with the names
    made here are replaced. No shuffle; whole texts; memory is one slice of texts or the longest text.
    """
    made = [x.split()[0] for x in SCHEMA.split(", ")]
    clean = docs.drop(*made, "base_failed", "fertility_failed", "reason", "kept")
    out_schema = StructType(clean.schema.fields + StructType.fromDDL(SCHEMA).fields)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = list(zip(*measures(batch.column(batch.schema.get_field_index(text)), vocabulary), strict=True))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c) for c in columns)], names=[*batch.schema.names, *made]
            )

    rated = clean.mapInArrow(work, out_schema)
    free = next(name for k in range(len(clean.columns) + 1) if (name := f"band_{k}") not in clean.columns)
    band = F.coalesce(
        *[F.when(F.col(key) == name, F.array(*map(F.lit, map(float, limits)))) for key in ([lang] if lang in clean.columns else []) for name, limits in bands.items()],
        *[F.when(F.col("script") == name, F.array(*map(F.lit, map(float, limits)))) for name, limits in bands.items()],
        F.array(*map(F.lit, map(float, bands["other"]))),
    )
    room = F.log2(F.least(F.greatest(F.col("n_tokens"), F.lit(2)), F.lit(2048)).cast("double"))
    base = F.when(F.col("n_words") < 50, "few_words").when(100 * F.col("n_repeat_words") > 50 * F.col("n_words"), "repeats")
    fertility = (
        F.when(F.col("chars_per_token") < F.col(free)[0], "chars_per_token_low")
        .when(F.col("chars_per_token") > F.col(free)[1], "chars_per_token_high")
        .when(F.col("byte_fallback_share") > F.col(free)[2], "byte_fallback")
        .when(F.col("token_entropy") < F.col(free)[3] * room, "token_entropy")
    )
    return (
        rated.withColumn(free, band)
        .withColumns({"base_failed": base.isNotNull(), "fertility_failed": fertility.isNotNull(), "reason": F.coalesce(base, fertility)})
        .withColumn("kept", F.col("reason").isNull())
        .drop(free)
    )
