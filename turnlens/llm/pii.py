"""Personal data (operator 4): anchors found by Aho-Corasick, boundaries set and validated by local parsers."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Kinds in the order of the results; the first four have fixed patterns, the others are this method's own.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")
#: Words that announce an account or another personal identifier.
CUES = (
    "account", "acct", "iban", "ssn", "social security", "passport", "customer id", "user id", "member id", "tax id",
    "token", "api_key", "apikey", "api key", "secret", "password", "passwd", "license no", "licence no",
)
#: Schemes of web addresses that lead to a person or an account.
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:", "sip:")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CARD_ZONE, _CARD = re.compile(r"[0-9 \-]+"), re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_VALUE = re.compile(r"(?:[ _-]?(?:no|nr|number|id|key)\b\.?)?[ \t]*(?:[:=#][ \t]*|is[ \t]+)?[\"']?([A-Za-z0-9][A-Za-z0-9_-]{5,127})")
_ADDRESS = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
#: The most characters of a host with its user, of a mailbox and of a telephone number in a web address.
_HOST, _MAILBOX, _TEL = 512, 320, 64
_DOTTED = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\[[0-9A-Fa-f:]+\]|localhost")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
        found.add_word(f"+{digit}", ("plus", 2))
    found.add_word("@", ("at", 1))
    for scheme in SCHEMES:
        for word in {scheme, scheme.upper(), scheme.capitalize()}:
            found.add_word(word, ("scheme", len(word)))
    for cue in CUES:
        for word in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(word, ("cue", len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    doubled = [2 * int(c) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 * (x > 9) for x in doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _card_ok(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _byte_ok(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255


def _ips(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """Addresses in the chain of dotted numbers at ``start``, and its end. The numbers are taken by fours from the left,
    which are the leftmost matches; a chain is read once, however long it is."""
    chain = _NUMBERS.match(text, start)
    parts, out, at = chain.group().split("."), [], start
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        size = sum(map(len, four)) + 3
        if all(map(_byte_ok, four)):
            out.append((at, at + size))
        at += size + 1
    return out, chain.end()


def _address(text: str, start: int, after: int, end: int) -> int | None:
    """End of the web address whose scheme ends at ``after``, of the characters up to ``end``; None if it has no host,
    mailbox or number."""
    scheme = text[start:after].lower()
    if scheme in ("mailto:", "sip:", "tel:"):
        end = min(end, after + (_TEL if scheme == "tel:" else _MAILBOX))
    while end > after and text[end - 1] in ".,;:!?)":
        end -= 1
    body = text[after : min(end, after + _HOST)]
    if scheme == "tel:":
        return end if len(_digits(body)) >= 7 else None
    host = re.split(r"[/?#]", body, maxsplit=1)[0].rpartition("@")[2]
    if not _DOTTED.match(host) or scheme in ("mailto:", "sip:") and "@" not in body:
        return None
    return end


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind in code points, end exclusive, each kind leftmost and non-overlapping, in order of their starts."""
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    at_end = email_end = card_to = ip_to = address_to = account_to = zone_to = 0
    for last, (what, length) in _automaton().iter(text):
        start, after = last + 1 - length, last + 1
        if what == "digit":
            if start >= card_to:
                card_to = _CARD_ZONE.match(text, start).end()
                if card_to - start >= 13:
                    out["card"] += [m.span() for m in _CARD.finditer(text, start, card_to) if _card_ok(m.group())]
            if start >= ip_to:
                found, ip_to = _ips(text, start)
                out["ip"] += found
        elif what == "at":
            before = text[max(at_end, email_end) : start]
            local = len(before) - len(before.rstrip(_LOCAL))
            at_end = after
            if local and (domain := _DOMAIN.match(text, start)):
                email_end = domain.end()
                out["email"].append((start - local, email_end))
        elif what == "plus":
            if (number := _PHONE.match(text, start)) and 9 <= len(_digits(number.group())) <= 15:
                out["phone"].append(number.span())
        elif what == "scheme":
            if after >= zone_to:
                zone_to = zone.end() if (zone := _ADDRESS.match(text, after)) else after
            if start >= address_to and not (start and text[start - 1].isalnum()) and (end := _address(text, start, after, zone_to)):
                address_to = end
                out["address"].append((start, end))
        elif start >= account_to and not (start and text[start - 1].isalnum()):
            value = _VALUE.match(text, after)
            if value and sum("0" <= c <= "9" for c in value.group(1)) >= 4:
                account_to = value.end(1)
                out["account"].append(value.span(1))
    return out


def _joined(spans: dict, kinds: tuple) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in kinds for s, e in spans[kind])


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_<kind> for every kind, n_spans (all kinds), base_spans and spans (kind:start:end,
    comma-joined).

    Whole texts; a null text counts as empty and has no spans. Base kinds are exactly the leftmost non-overlapping
    matches of their patterns, dropped without a retry where parts exceed 255, or the digits or the Luhn check fail.
    Added kinds: address (web addresses by scheme) and account (values of four digits or more after an identifier
    cue). Rows, ties and repeats stay as they are; other columns are not read. No shuffle.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = StructType.fromDDL(", ".join(f"n_{kind} long" for kind in KINDS) + ", n_spans long, base_spans string, spans string")
    schema = StructType(source.schema.fields[:1] + made.fields)

    def work(batches):
        for batch in batches:
            columns = [[] for _ in made]
            for value in batch.column(1):
                spans = find_spans(value.as_py() or "")
                counts = [len(spans[kind]) for kind in KINDS]
                row = [*counts, sum(counts), _joined(spans, BASE_KINDS), _joined(spans, KINDS)]
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=pa.string() if k > len(KINDS) else pa.int64()) for k, c in enumerate(columns))],
                names=schema.names,
            )

    return source.mapInArrow(work, schema).withColumnRenamed("key", key)


def base_digest(spans) -> F.Column:
    """Lower-case hex SHA-256 of a span string."""
    return F.sha2(spans, 256)


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    parts, at = [], 0
    for s, e, kind in sorted((s, e, kind) for kind, found in spans.items() for s, e in found):
        if e <= at:
            continue
        if s >= at:
            parts += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(parts) + text[at:]
