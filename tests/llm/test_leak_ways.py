"""Leaks by names that open sentences, by names of several words, over gaps, and word by word."""

import random

import pytest
import regex

from runsift.llm import decontaminate

MARIA = "Maria buys 3 apples at the market. Maria eats one of them. Maria gives the rest to Peter at home."
BUS = "A bus left with 12 riders and took on 7. Anna then counted them all and found 3 more."
PENS = "In spring the kind old teacher asked her pupil Peter to bring 4 red pens and 6 blue ones back."
LONG = " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(25))
TRAIN = "A train goes 60 km from Paris to Lyon in 2 hours at noon. How fast is the train to Lyon, then?"


def found(spark, docs, items, **options):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.leaks(d, b, **options).collect()}


def test_names_that_open_a_sentence(spark):
    docs = [
        MARIA.replace("Maria", "Helen").replace("3", "7"),
        BUS.replace("Anna", "Boris"),
        MARIA.replace("Maria", "Helen", 1).replace("Maria eats", "Clara eats").replace("3", "7"),  # one value of the item, three of the document
        'So "' + MARIA.replace("Maria", "Helen") + '"',
    ]
    rows = found(spark, docs, [MARIA, BUS])
    assert sorted(rows) == [(0, 0), (1, 1), (3, 0)]
    assert not any(r.exact for r in rows.values())


def test_names_of_several_words_and_gaps(spark):
    words = LONG.split()
    docs = [
        PENS.replace("Peter", "Anna"),
        PENS.replace("Peter", "Mary Ann"),
        " ".join(words[:12] + ["more"] + words[12:]),
        " ".join(words[:12] + words[13:]),
        " ".join(words[:12] + ["more"] * 9 + words[12:]),
    ]
    rows = found(spark, docs, [PENS, LONG])
    assert sorted(k for k in rows if k[1] == 0) == [(0, 0), (1, 0)]
    assert {(2, 1)} <= set(rows) and rows[2, 1].n_windows == 17


def test_words_in_a_row_count_whatever_differs_beside_them(spark):
    docs = [TRAIN.replace("to Lyon,", "to Ulm,"), TRAIN.replace("Lyon", "Ulm", 1), "none of it"]
    assert found(spark, docs, [TRAIN], verbatim=False) == {}
    rows = found(spark, docs, [TRAIN])
    assert (0, 0) in rows and rows[0, 0].longest_words >= 13 and rows[0, 0].exact


def test_rows_are_judged_by_themselves(spark):
    rows = [(None, TRAIN), (None, "clean"), (1, "clean too"), (1, TRAIN), (2, TRAIN), (3, None)]
    docs = spark.createDataFrame([(k, t, "d", 0, "r") for k, t in rows], "doc_id bigint, text string, _dirty string, _gone int, _row string")
    items = spark.createDataFrame([(0, TRAIN)], "item_id bigint, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r._dirty, r._gone, r._row) for r in kept.collect()) == [
        (0, "clean", "d", 0, "r"), (1, "clean too", "d", 0, "r"), (3, "", "d", 0, "r")
    ]


# -- against plain loops -------------------------------------------------------------------------
def words_of(text):
    """(mark, word) of every word."""
    t = regex.sub(r"[\^=~|]", " ", text or "")
    t = regex.sub(r"(?<=[\p{Ll},] )(?=\p{Lu}\p{Ll})", "^", t)
    t = regex.sub(r"(\^[\p{L}\p{M}]+) (?=\^)", r"\1|", t)
    t = regex.sub(r"(?<![\p{L}\p{N}\p{M}^])(?=\p{Lu}\p{Ll})", "~", t)
    t = regex.sub(r"(?<![\p{L}\p{N}])(?=\p{N})", "=", t)
    t = regex.sub(r"(?<!\p{N})[.,]|[.,](?!\p{N})|[^\p{L}\p{N}\p{M}^=~|.,]+", " ", t.lower())
    return t.split()


def windows_of(text, words):
    """(template, slots or None, named) of every window; a slot is None where the word is plain."""
    raw = words_of(text)
    kinds = []
    for k, w in enumerate(raw):
        unit = k and raw[k - 1].startswith("=") and w.lstrip("~") in decontaminate.UNITS
        kinds.append("<n>" if w[0] == "=" else "<p>" if w[0] == "^" else "<u>" if unit else w)
    out = []
    for i in range(len(raw) - words + 1):
        for named in (False, True):
            if named and not any(w[0] == "~" for w in raw[i : i + words]):
                continue
            shape, slots = [], []
            for w, kind in zip(raw[i : i + words], kinds[i : i + words]):
                maybe = kind[0] == "~"
                kind = ("<p>" if named else kind.lstrip("~")) if maybe else kind
                shape.append(kind)
                slots.append((w.replace("~", "^") if named else w) if kind in ("<n>", "<p>", "<u>") else None)
            out.append((i, tuple(shape), tuple(slots) if any(slots) else None, named))
    return out


def plain_leaks(docs, items, words=5, covered=0.8, longest=13):
    out = {}
    shapes = [windows_of(t, words) for t in docs]
    for n, item in enumerate(items):
        mine = windows_of(item, words)
        size = len({w[0] for w in mine})
        for d, theirs in enumerate(shapes):
            hits = {(a, p - a, x, y, na or nb) for a, s, x, na in mine for p, z, y, nb in theirs if s == z}
            ways = []
            for test in (lambda h: True, lambda h: not h[4], lambda h: not h[4] and (h[2] is None or h[2] == h[3])):
                some = [h for h in hits if test(h)]
                for group in (lambda s: [s], lambda s: [("span", s // 4), ("span", s // 4 + 1)]):
                    by = {}
                    for h in some:
                        for g in group(h[1]):
                            by.setdefault(g, []).append(h)
                    ways += by.values()
            for way in ways:
                places = {h[0] for h in way}
                runs = 0
                for shift in {h[1] for h in way}:
                    at = {h[0] for h in way if h[1] == shift}
                    runs = max(runs, max(next(k for k in range(1, 10**6) if a + k not in at) for a in at))
                if len(places) < covered * size and runs + words - 1 < longest:
                    continue
                pairs = {(h[0] + k, x, y) for h in way if h[2] for k, (x, y) in enumerate(zip(h[2], h[3])) if x is not None}
                if any(len({b for _, x, b in pairs if x == a}) > 1 for a in {x for _, x, _ in pairs}):
                    continue
                if any(len({a for _, a, y in pairs if y == b}) > 1 for b in {y for _, _, y in pairs}):
                    continue
                out[d, n] = max(out.get((d, n), (0, 0)), (len(places), runs + words - 1))
    return out


@pytest.mark.parametrize("sent", [200_000, 0])
def test_leaks_are_those_of_plain_loops(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "SENT_WINDOWS", sent)
    dice = random.Random(11)
    bits = ["the", "a", "went", "to", "Paris", "Anna", "Boris Lee", "3", "7", "4,5", "km", "kg", "hours", "of", "red", "Then", "and", "élan", "x2", "9km"]

    def prose(n):
        return "".join(dice.choice(bits) + dice.choice([" ", " ", " ", ". ", ", ", '" "', "\n"]) for _ in range(n))

    items = [prose(dice.randint(6, 28)) for _ in range(14)] + [TRAIN, MARIA, "too short", None]
    docs = [None, "", prose(400)]
    for _ in range(70):
        part = dice.choice(items) or ""
        for _ in range(dice.randrange(4)):
            a, b = dice.choice(bits), dice.choice(bits)
            part = part.replace(a, b, dice.choice([1, -1]))
        cut = part.split(" ")
        if cut and dice.random() < 0.4:
            cut.insert(dice.randrange(len(cut)), dice.choice(bits))
        docs.append(prose(dice.randrange(12)) + " ".join(cut) + " " + prose(dice.randrange(12)))
    want = plain_leaks(docs, items)
    assert len(want) > 25
    rows = found(spark, docs, items)
    assert {k: (r.n_windows, r.longest_words) for k, r in rows.items()} == want
