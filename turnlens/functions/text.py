"""Column functions on text, time and vectors (reference scalar functions F*, C1, C2, K9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value, use) -> Column:
    """``use(value)``, with ``value`` worked out once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c) -> Column:
    """Trims all white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def count_tokens(c) -> Column:
    """About four characters a token, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor((F.length(c) + 3) / 4))


def seconds_to_human(ms) -> Column:
    """H:MM:SS from an hour on, else MM:SS; part seconds are cut off."""
    s = F.floor(F.col(ms) / 1000).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def time_range(start_ms, end_ms) -> Column:
    """[MM:SS–MM:SS], with hours on both sides if either end has one."""
    long = F.greatest(start_ms, end_ms) >= 3_600_000

    def one(ms):
        s = F.greatest(F.lit(0), F.floor(F.col(ms) / 1000)).cast("long")
        h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long")
        return F.when(long, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))

    return F.concat(F.lit("["), one(start_ms), F.lit("–"), one(end_ms), F.lit("]"))


def srt_time(ms) -> Column:
    """HH:MM:SS,mmm."""
    c = F.col(ms)
    part = lambda x: F.floor(x).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", part(c / 3_600_000), part(c % 3_600_000 / 60_000), part(c % 60_000 / 1000), (c % 1000).cast("long"))


def cosine(a, b) -> Column:
    """F16: cosine similarity, with 1e-8 added to each norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-8) * (F.sqrt(dot(b, b)) + 1e-8))


def duration_seconds(c) -> Column:
    """seconds from texts like 1d2h3m4.5s (each number counts with the first letter after it); null if nothing
    matches or a number is none."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9.]+)\s*([dhms])"), F.lit(0))
    unit = F.create_map(*[F.lit(x) for pair in (("d", 86400.0), ("h", 3600.0), ("m", 60.0), ("s", 1.0)) for x in pair])
    value = lambda p: F.regexp_extract(p, r"^[0-9.]+", 0).try_cast("double") * unit[F.right(p, F.lit(1))]
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, p: s + value(p)))


def retryable(status) -> Column:
    """whether a call that failed with this status (null: none) may be made again."""
    return F.col(status).isNull() | F.col(status).isin(408, 409, 429) | (F.col(status) >= 500)


def retry_wait(attempt, retry_after) -> Column:
    """seconds to wait: two to the power of the attempt, or half a second more than the answer asked for."""
    back = F.pow(F.lit(2.0), F.col(attempt))
    return F.greatest(back, F.coalesce(F.col(retry_after).try_cast("double") + 0.5, back))


def requested_tokens(content, most) -> Column:
    """half a token a character (one at least) and the tokens reserved for the answer."""
    return (F.greatest(F.lit(1), F.ceil(F.length(content) / 2)) + F.greatest(F.lit(0), F.coalesce(most, F.lit(0)))).cast("long")


#: How live recordings are named, and where their times are shown.
LIVE, ZONE, NAMELESS = "realtime_", "Asia/Ho_Chi_Minh", "Tài liệu"


def _base(name) -> Column:
    return F.regexp_extract(name, r"([^/]*)/*$", 1)


def _stem(name) -> Column:
    return F.regexp_replace(_base(name), r"(?<=.)\.[^.]+$", "")


def _local(at, pattern: str) -> Column:
    return F.date_format(F.from_utc_timestamp(at, ZONE), pattern)


def is_live_name(name) -> Column:
    """whether a file name was made for a live recording."""
    return F.startswith(_base(name), F.lit(LIVE))


def display_name(name, at) -> Column:
    """the name shown: the file's, or the local time of a live recording."""
    return F.when(is_live_name(name), F.concat(F.lit("Ghi âm trực tiếp · "), _local(at, "dd/MM/yyyy HH:mm"))).otherwise(F.col(name))


def export_label(name, at) -> Column:
    """the same for file names: without an extension, and no slashes or colons in times."""
    return F.when(is_live_name(name), F.concat(F.lit("Ghi âm "), _local(at, "dd-MM-yyyy HH-mm"))).otherwise(F.coalesce(F.nullif(_stem(name), F.lit("")), F.lit(NAMELESS)))


def document_label(name, at) -> Column:
    """the name inside an exported document."""
    return F.when(is_live_name(name), display_name(name, at)).otherwise(F.coalesce(F.nullif(_stem(name), F.lit("")), F.lit(NAMELESS)))


def export_title(name, at, mode) -> Column:
    """the stem of an export: the label for full texts, else the file's stem; document where nothing is known."""
    known = F.when(F.col(mode) == "full_text", F.concat(F.lit("Toàn văn - "), export_label(name, at))).otherwise(F.coalesce(F.nullif(_stem(name), F.lit("")), F.lit("document")))
    return F.when(F.col(name).isNull() | F.col(at).isNull(), "document").otherwise(known)


def encode_chars(c, alphabet: list[str]) -> Column:
    """token ids of the characters; 0 for those that the alphabet lacks."""
    ids = F.create_map(*[F.lit(x) for k, a in enumerate(alphabet) for x in (a, k)])
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(chars, lambda x: F.coalesce(F.try_element_at(ids, x), F.lit(0)))


def decode_chars(c, alphabet: list[str]) -> Column:
    """the text of token ids; ids out of range are left out."""
    tokens = F.array(*map(F.lit, alphabet))
    return F.array_join(F.transform(F.filter(c, lambda i: (i >= 0) & (i < len(alphabet))), lambda i: F.get(tokens, i)), "")


#: What \s of a regular expression matches.
_SPACE = " \t\n\x0b\f\r"


def chars_of_words(words) -> Column:
    """(c, s, e) of every character of words (array of text, s, e), trimmed at both ends: each has its word's time."""
    chars = lambda w: F.when(w["text"] != "", F.split(w["text"], "")).when(w["text"] == "", F.array().cast("array<string>"))
    each = lambda w: F.transform(chars(w), lambda c: F.struct(c.alias("c"), w["s"].alias("s"), w["e"].alias("e")))

    def trimmed(told):
        said = F.array_join(F.transform(told, lambda w: w["text"]), "")
        first = F.length(said) - F.length(F.ltrim(said, F.lit(_SPACE)))
        return F.slice(F.flatten(F.transform(told, each)), first + 1, F.length(F.ltrim(F.rtrim(said, F.lit(_SPACE)), F.lit(_SPACE))))

    return once(words, trimmed)


def chars_of_tokens(tokens) -> Column:
    """the same of sub-word tokens (array of text, s): a token lasts until the next one starts, the last one 80 ms;
    the mark of a word's start is a space."""
    col = F.col(tokens)
    words = F.transform(col, lambda t, k: F.struct(F.replace(t["text"], F.lit("▁"), F.lit(" ")).alias("text"), t["s"].alias("s"), F.coalesce(F.get(col, k + 1)["s"], t["s"] + 80).alias("e")))
    return chars_of_words(words)


def chars_of_aligned(text, words) -> Column:
    """(s, e) of every character of ``text`` by aligned units (array of text, s, e), found one after another; one
    that is not found takes the next characters. Characters between two units last from the end of the one to the start
    of the other (those before the first one as long as that), those after the last one as long as that."""
    here, time_type = F.col(text), "struct<s:bigint,e:bigint>"
    start = F.struct(here.alias("rest"), F.lit(None).cast(time_type).alias("last"), F.array().cast("array<struct<s:bigint,e:bigint,n:int>>").alias("out"))

    def step(st, w):
        # only the rest of the text is searched, and (time, count) is kept, not a time a character
        def taken(low):
            high = F.least(F.length(st["rest"]), low + F.length(w["text"]))
            end = F.greatest(w["s"], w["e"])
            piece = lambda s, e, n: F.struct(s.alias("s"), e.alias("e"), n.cast("int").alias("n"))
            gap = F.when(st["last"].isNull(), piece(w["s"], end, low)).otherwise(piece(st["last"]["e"], F.greatest(st["last"]["e"], w["s"]), low))
            out = F.concat(st["out"], F.array(gap, piece(w["s"], end, high - low)))
            return F.struct(F.substring(st["rest"], high + 1, F.length(st["rest"])).alias("rest"), F.struct(w["s"].alias("s"), end.alias("e")).alias("last"), out.alias("out"))

        low = F.greatest(F.lit(0), F.position(w["text"], st["rest"]) - 1)
        return F.when((st["rest"] == "") | (w["text"] == ""), st).otherwise(once(low, taken))

    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e"))
    times = lambda st: F.flatten(F.transform(st["out"], lambda p: F.array_repeat(F.struct(p["s"].alias("s"), p["e"].alias("e")), p["n"])))
    end = F.aggregate(words, start, step, lambda st: F.concat(times(st), F.array_repeat(F.coalesce(st["last"], zero), F.length(st["rest"]))))
    return F.when((F.size(words) > 0) & (F.length(here) > 0), end).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))


def shift_times(times, offset_ms) -> Column:
    """(s, e) of every character moved by the offset of its segment; null times and entries stay null, a null offset
    gives null times."""
    shift = F.col(offset_ms) if isinstance(offset_ms, str) else offset_ms
    return F.transform(times, lambda t: F.when(t.isNotNull(), F.struct((t["s"] + shift).alias("s"), (t["e"] + shift).alias("e"))))


def timing_weight(c) -> Column:
    """visible characters."""
    return F.length(F.regexp_replace(c, r"\s+", "")).cast("long")


def sanitize_filename(c) -> Column:
    """characters that file names cannot hold become underscores, ends are trimmed, at most 80 remain; reserved
    device names get an underscore in front and empty names become document."""
    clean = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1F]', "_"), r"^[\s.]+|[\s.]+$", "")
    short = F.regexp_replace(F.substring(clean, 1, 80), r"[\s.]+$", "")
    reserved = F.upper(F.regexp_extract(short, r"^[^.]*", 0)).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    return F.when(short == "", "document").when(reserved, F.concat(F.lit("_"), short)).otherwise(short)


def strip_tags(c) -> Column:
    """leading <|...|> marks of a recogniser go."""
    return F.regexp_replace(c, r"^(?:<\|[^|]+\|>)+", "")


def representative_sample(c, budget: int, separator: str = "\n...\n") -> Column:
    """The text if it fits, else head, middle and tail of a third each within ``budget`` characters."""
    room = budget - 2 * len(separator)
    if room <= 0:
        return F.substring(c, 1, budget)
    head = room // 3
    tail = room - 2 * head
    length, col = F.length(c), F.col(c)
    middle = F.greatest(F.lit(0), F.floor(length / 2).cast("int") - head // 2)
    cut = F.concat(F.substring(c, 1, head), F.lit(separator), col.substr(middle + 1, F.lit(head)), F.lit(separator), F.right(col, F.lit(tail)))
    return F.when(length <= budget, col).otherwise(cut)


def pcm16(c) -> Column:
    """Samples clamped to [-1, 1], scaled by 0x8000 below zero and by 0x7fff else, cut to integers."""
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    return F.when(x < 0, F.ceil(x * 32768)).otherwise(F.floor(x * 32767)).cast("int")


def circle_pad(array, n: int) -> Column:
    """An array repeated until ``n`` items are full."""
    whole = F.flatten(F.array_repeat(array, F.ceil(F.lit(n) / F.greatest(F.size(array), F.lit(1))).cast("int")))
    return F.slice(whole, 1, n)


def fixed(name: str, digits: int) -> Column:
    """Seconds with ``digits`` (1 or 2) decimals of whole milliseconds: ms / 1000 as a double, rounded by its exact value.

    Only ties in decimal need the exact value: the double is split in halves of 26 bits, so that 1000 times each half is
    exact, and so is the difference from ms. It tells on which side of the tie the double lies; on it, even digits win."""
    ms, unit = F.abs(F.col(name)), 10 ** (3 - digits)
    whole, rest = F.floor(ms / unit), ms % unit
    v = ms / F.lit(1000.0)
    high = v * 134217729.0 - (v * 134217729.0 - v)
    side = (high * 1000.0 - ms) + (v - high) * 1000.0
    up = (rest * 2 > unit) | ((rest * 2 == unit) & ((side > 0) | ((side == 0) & (whole % 2 == 1))))
    n = (whole + F.when(up, 1).otherwise(0)).cast("long")
    sign = F.when(F.col(name) < 0, "-").otherwise("")
    return F.concat(sign, F.floor(n / 10**digits).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))


def stamped_line(start_ms, speaker, text) -> Column:
    """[seconds with two decimals] speaker: text."""
    return F.concat(F.lit("["), fixed(start_ms, 2), F.lit("] "), F.col(speaker), F.lit(": "), F.col(text))


def shifted_times(ts, offset_ms) -> Column:
    """Character times (an array of (s, e)) moved by an offset to the common time line."""
    return F.transform(ts, lambda t: F.named_struct(F.lit("s"), t["s"] + offset_ms, F.lit("e"), t["e"] + offset_ms))
