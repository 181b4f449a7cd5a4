"""Anchors and parsers against searches with the patterns."""

import hashlib
import random
import re

from runsift.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = re.sub(r"[^0-9]", "", text)
    return {
        "email": True,
        "ip": all(int(p) <= 255 for p in text.split(".")) if kind == "ip" else None,
        "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
        "phone": 8 <= len(digits) <= 15,
    }[kind]


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if holds(k, m[0])] for k, p in PATTERNS.items()}


def texts():
    dice = random.Random(1)
    out = ["".join(dice.choice("0123456789 -..+()@@ab_%é\n") for _ in range(dice.randint(0, 30))) for _ in range(3000)]
    out += ["".join(dice.choice("0123456789 -.") for _ in range(dice.randint(0, 60))) for _ in range(3000)]
    card = "4539 1488 0343 6467"
    return out + [None, "", card, card.replace(" ", "-"), card + "0", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "1.2.3.400", "+1 (555) 010-9999", "9" * 5000, "1." * 4000]


def test_base_kinds_are_what_the_patterns_find(documents):
    rows = texts()
    found = {r.doc_id: r for r in pii.pii_digest(documents(rows)).collect()}
    for k, text in enumerate(rows):
        want = brute(text or "")
        listed = ",".join(f"{kind}:{s}:{e}" for kind in PATTERNS for s, e in want[kind])
        row = found[k]
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), text
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [len(v) for v in want.values()]
        assert [s for s in row.spans.split(",") if s.split(":")[0] in PATTERNS] == [s for s in listed.split(",") if s]


def test_other_kinds_and_redaction(documents):
    text = (
        "IBAN DE89 3704 0044 0532 0130 00, account no. 12345678, 12 Baker Street, Hauptstraße 5, "
        "https://bob:pw@host.example/x and password=abcdef123456"
    )
    row = pii.find_pii(documents([text])).first()
    kinds = [(s.kind, text[s.start : s.end]) for s in row.pii]
    assert kinds == [
        ("email", "pw@host.example"),
        ("account", "DE89 3704 0044 0532 0130 00"),
        ("account", "12345678"),
        ("address", "12 Baker Street"),
        ("address", "Hauptstraße 5"),
        ("login", "https://bob:pw@host.example"),
        ("secret", "abcdef123456"),
    ]
    assert row.redacted == (
        "IBAN [ACCOUNT], account no. [ACCOUNT], [ADDRESS], [ADDRESS], [LOGIN]/x and password=[SECRET]"
    )
    assert row.text == text and row.score == "x"


def test_clean_words_with_cues_stay(documents):
    clean = ["On account of the road, the street was long.", "rue the day", "a token of thanks", "IBAN DE00 1234 5678 9012 3456 78"]
    rows = pii.find_pii(documents(clean)).collect()
    assert [[s.kind for s in r.pii] for r in rows] == [[], [], [], []]


def test_nulls_and_empty_tables(documents):
    assert [r.redacted for r in pii.find_pii(documents([None, ""])).orderBy("doc_id").collect()] == [None, ""]
    assert pii.find_pii(documents([])).count() == 0


def test_long_secrets_are_taken_whole(documents):
    value = "Ab3.-_/+" * 125
    texts = [f"token={value} end", f'secret: "{value}" api_key={value}', "secret=abcdefgh_token=\"realvalue123\"", "token=" * 30_000]
    rows = {r.doc_id: r for r in pii.find_pii(documents(texts)).collect()}
    assert [(s.kind, s.end - s.start) for s in rows[0].pii if s.kind == "secret"] == [("secret", 1000)]
    assert rows[0].redacted == "token=[SECRET] end"
    assert [s.end - s.start for s in rows[1].pii if s.kind == "secret"] == [1000, 1000]
    assert "realvalue123" not in rows[2].redacted
    assert rows[3].redacted == "token=[SECRET]"
