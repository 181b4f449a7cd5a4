"""Personal data in texts: anchors found by one automaton, expanded and checked by local parsers.

One Aho-Corasick automaton runs over a text and reports anchors: at-signs, plus signs before a
digit, digits side by side or with one separator between, schemes, and identifier cues. At each
anchor a small deterministic parser widens to the left and right and checks what it has found
(label structure, number ranges, digit counts, check sums). Parsers of a kind go from left to right
and do not overlap, so the four base kinds give what a search with their patterns gives:

email  `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`
ip     four numbers of at most 255 with dots between
card   16 to 19 digits, single spaces or hyphens between, with a right Luhn sum
phone  `\\+[0-9][\\x20().0-9-]+[0-9]` with 8 to 15 digits

The other kinds: `account` (IBAN with a right check sum, or 6 to 17 digits behind an account cue),
`address` (house number beside a street cue), `login` (user name or password inside a URL) and
`secret` (value behind a password or key cue).

Null and empty texts have no spans. Offsets count code points, ends are exclusive. Texts are read
whole; the time is linear in the text but for cues, which look at most LOOK characters around (the
value of a secret is read to its end, once).
Equal rows give equal results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsift.llm.common import beside_text, slices, whole_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address", "login", "secret")
#: Characters around an identifier cue within which its value may stand.
LOOK = 80

ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
STREET_CUES = (" street", " st.", " avenue", " ave.", " road", " lane", "straße", "strasse", "rue ", "calle ")
SECRET_CUES = ("password", "passwd", "pwd", "api_key", "apikey", "secret", "token", "akia")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
SPACED = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"[0-9][ ().0-9-]+[0-9]")
AUTHORITY = re.compile(r"[^\s/?#\"'<>]+")
IBAN = re.compile(r"[\s:#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
ACCOUNT = re.compile(r"(?:\s?(?:no|nr|number|num|nummer)\b)?[.:#\s]{0,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
STREET_BEFORE = re.compile(r"[0-9]{1,6}[A-Za-z]?(?: [A-ZÀ-Þ][\w'-]{0,30}){0,4}$")
STREET_AFTER = re.compile(r" ?[0-9]{1,6}[A-Za-z]?\b")
ROAD_NAME = re.compile(r"(?:[\w'-]{1,30} ){1,5}[0-9]{1,6}[A-Za-z]?\b|[\w'-]{1,30},? [0-9]{1,6}\b")
NUMBER_FIRST = re.compile(r"[0-9]{1,6},? $")
SECRET_GAP = re.compile(r"(?:\"|')?\s{0,2}[=:]\s{0,2}(?:\"|')?")
SECRET = re.compile(r"[^\s\"'<>]{8,}")
KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")


def _forms(cue: str) -> set[str]:
    return {cue, cue.upper(), cue.title(), cue.capitalize()}


def automaton():
    """All anchors in one automaton; the value says which parser looks at the place."""
    import ahocorasick

    found = ahocorasick.Automaton()
    anchors = {"@": "at", "://": "scheme"}
    for a in "0123456789":
        anchors["+" + a] = "plus"
        for b in "0123456789":
            anchors[f"{a}.{b}"] = "dot"
            anchors |= {a + b: "digits", f"{a} {b}": "digits", f"{a}-{b}": "digits"}
    for cues, kind in ((ACCOUNT_CUES, "account"), (STREET_CUES, "street"), (SECRET_CUES, "secret")):
        anchors |= {form: kind for cue in cues for form in _forms(cue)}
    for anchor, kind in anchors.items():
        found.add_word(anchor, (len(anchor), kind))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def byte_number(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


class Finder:
    def __init__(self) -> None:
        self.anchors = automaton()

    def spans(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """Kind -> spans in order."""
        found: dict[str, list[tuple[int, int]]] = {}
        done = dict.fromkeys(KINDS, 0)

        def add(kind: str, start: int, end: int) -> None:
            if start >= done[kind]:
                found.setdefault(kind, []).append((start, end))
                done[kind] = end

        for last, (size, anchor) in self.anchors.iter(text):
            if anchor == "digits":
                if last >= done["card"]:
                    self._card(text, last - size + 1, done, add)
            elif anchor == "at":
                self._email(text, last, done["email"], add)
            elif anchor == "dot":
                if last >= done["ip"]:
                    self._ip(text, last - 2, done, add)
            elif anchor == "plus":
                m = PHONE.match(text, last)
                if m and 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    add("phone", last - 1, m.end())
            elif anchor == "scheme":
                self._login(text, last, add)
            elif anchor == "account":
                self._account(text, last + 1, add)
            elif anchor == "street":
                self._street(text, last - size + 1, last + 1, add)
            else:
                self._secret(text, last - size + 1, last + 1, done["secret"], add)
        return found

    @staticmethod
    def _email(text: str, at: int, least: int, add) -> None:
        start = at
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            add("email", start, m.end())

    @staticmethod
    def _ip(text: str, start: int, done: dict[str, int], add) -> None:
        while start > done["ip"]:
            c = text[start - 1]
            if c in DIGITS:
                start -= 1
            elif c == "." and start - 1 > done["ip"] and text[start - 2] in DIGITS:
                start -= 2
            else:
                break
        chain = DOTTED.match(text, start)
        parts = chain[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(map(byte_number, four)):
                add("ip", start, end)
            start = end + 1
        done["ip"] = chain.end()

    @staticmethod
    def _card(text: str, start: int, done: dict[str, int], add) -> None:
        least = done["card"]
        while start > least:
            c = text[start - 1]
            if c in DIGITS:
                start -= 1
            elif c in " -" and start - 1 > least and text[start - 2] in DIGITS:
                start -= 2
            else:
                break
        chain = SPACED.match(text, start)
        digits = chain[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            add("card", start, chain.end())
        done["card"] = chain.end()

    @staticmethod
    def _login(text: str, last: int, add) -> None:
        m = AUTHORITY.match(text, last + 1)
        if m and 0 < m[0].rfind("@") < len(m[0]) - 1:
            start = last - 2
            while start > 0 and last - start < LOOK and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            add("login", start, m.end())

    @staticmethod
    def _account(text: str, end: int, add) -> None:
        m = IBAN.match(text, end, end + LOOK)
        if m:
            value = m[1]
            while len(value) >= 15:
                if value[-1] != " " and iban(value):
                    add("account", m.start(1), m.start(1) + len(value))
                    return
                value = value[:-1]
        m = ACCOUNT.match(text, end, end + LOOK)
        if m:
            add("account", m.start(1), m.end(1))

    @staticmethod
    def _street(text: str, start: int, end: int, add) -> None:
        if text[end - 1] == " ":  # the cue comes before the name
            m = ROAD_NAME.match(text, end, end + LOOK)
            before = NUMBER_FIRST.search(text, max(0, start - 10), start)
            if before:
                m = re.compile(r"(?:[\w'-]{1,30} ?){1,5}").match(text, end, end + LOOK)
                if m:
                    add("address", before.start(), m.end())
            elif m and (start == 0 or not text[start - 1].isalnum()):
                add("address", start, m.end())
            return
        m = STREET_BEFORE.search(text, max(0, start - LOOK), start) if text[start] == " " else None
        if m:
            add("address", m.start(), end)
            return
        m = STREET_AFTER.match(text, end, end + 10)
        if m and text[start] != " ":
            while start > 0 and end - start < LOOK and text[start - 1].isalpha():
                start -= 1
            add("address", start, m.end())

    @staticmethod
    def _secret(text: str, start: int, end: int, least: int, add) -> None:
        m = KEY_ID.match(text, start)
        if m:
            add("secret", start, m.end())
            return
        gap = SECRET_GAP.match(text, end)
        # A value inside the last span is not read again.
        m = SECRET.match(text, gap.end()) if gap and gap.end() >= least else None
        if m:
            add("secret", m.start(), m.end())


_FINDER: list[Finder] = []


def finder() -> Finder:
    """One automaton for each worker process."""
    if not _FINDER:
        _FINDER.append(Finder())
    return _FINDER[0]


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans.get(k, ()))


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with a typed mark in place of each span; overlapping spans become one mark, of the
    one that starts first (the longest of those)."""
    out, at = [], 0
    for start, end, kind in sorted(((s, e, k) for k, each in spans.items() for s, e in each), key=lambda x: (x[0], -x[1])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs and pii, an array of (kind, start, end), and redacted, the text with
    marks in place of the spans (null where the text is null). Columns of docs with these names
    give way to the new ones."""
    import pyarrow as pa

    kept = [c for c in docs.columns if c not in ("pii", "redacted")]
    span = T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())
    schema = docs.select(*kept).schema.add("pii", T.ArrayType(span)).add("redacted", T.StringType())
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in slices(batches):
            spans, clean = [], []
            for t in batch.column(place).to_pylist():
                got = find.spans(t) if t else {}
                spans.append([{"kind": k, "start": s, "end": e} for k in KINDS for s, e in got.get(k, ())])
                clean.append(redacted(t, got) if got else t)
            made = [pa.array(spans, arrow), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(kept)] + made, names=[*kept, "pii", "redacted"])

    rows, place = beside_text(docs, kept, text)
    return rows.mapInArrow(run, schema)


def pii_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, n_other, base_sha256 (of the listed base spans) and
    spans (all spans as kind:start:end)."""
    import pyarrow as pa

    kind = dict(docs.dtypes)[key]
    names = ["key", *[f"n_{k}" for k in BASE], "n_other", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in slices(batches):
            all_spans = [find.spans(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([len(s.get(k, ())) for s in all_spans], pa.int64()) for k in BASE]
            other = pa.array([sum(len(v) for k, v in s.items() if k not in BASE) for s in all_spans], pa.int64())
            digest = [hashlib.sha256(listed(s, BASE).encode()).hexdigest() for s in all_spans]
            columns = [batch.column(0), *counts, other, pa.array(digest), pa.array([listed(s) for s in all_spans])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"key {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", n_other bigint, base_sha256 string, spans string"
    return docs.select(F.col(key), whole_text(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
