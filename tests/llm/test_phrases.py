"""Phrases against plain counting; quotient filters as an exact round trip."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from runsift.llm import phrases, quotient as qf, word_shards as ws

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, inside=50):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= inside * a for q, b in f.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def check(spark, rows, least=3, top=50):
    df = spark.createDataFrame([(t, g, 1, "x", 0) for g, t in rows], "text string, lang string, n int, grp string, w1 int")
    found = phrases.collocations(df, least=least, top=top).drop("words")
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, least, top)


def texts(seed, n, words=12):
    dice = random.Random(seed)
    names = [f"W{k}" for k in range(words)] + ["Zoë", "ÉTÉ", "ß"]
    marks = [" ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "\x0b", "\x0c", "!?"]
    for _ in range(n):
        yield "".join(dice.choice(names) + dice.choice(marks) for _ in range(dice.randrange(60)))


@pytest.mark.parametrize("shard", [1 << 21, 40])
def test_random_texts_in_one_and_in_many_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(ws, "SHARD_TOKENS", shard)
    dice = random.Random(1)
    rows = [(dice.choice(["en", "de", None, "und", ""]), t) for t in texts(2, 150)]
    check(spark, rows)
    check(spark, rows, least=5, top=4)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANGE_ENTRIES", 64)
    check(spark, [("en", t) for t in texts(3, 120, 40)])


def test_steps_and_parts_of_a_shard(spark, monkeypatch):
    monkeypatch.setattr(phrases, "STEP", 7)
    monkeypatch.setattr(phrases, "RANGE_ENTRIES", 64)
    check(spark, [("en", t) for t in texts(6, 60)] + [(None, "a b c " * 30)])


def test_a_shard_is_counted_in_little_memory(monkeypatch):
    found = {}

    class Words:
        """A vocabulary of 2^18 ids and 2^24 tokens, and the table that is counted."""

        agg = select = groupBy = applyInArrow = lambda self, *_: self
        first = lambda self: (1 << 18, 1 << 24)

    monkeypatch.setattr(ws, "with_words", lambda shards, columns, known, run, schema: found.update(run=run) or known)
    monkeypatch.setattr(phrases, "F", type("F", (), {"__getattr__": lambda *_: lambda *_: None})())
    phrases.ngram_counts(None, Words(), 10)
    numbers = np.random.default_rng(7).integers(2, 1 << 18, 1 << 20).astype(np.int32)
    left = pa.table({"grp": ["en"], "numbers": pa.array([ws.packed(numbers)], pa.binary())})
    known = pa.table({"number": np.arange(2, 1 << 18), "id": np.arange(1, (1 << 18) - 1)})
    tracemalloc.start()
    out = found["run"](left, known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(out.column("n").to_pylist()) > 2_000_000
    assert peak < 90_000_000  # about two million n-grams


def test_rare_keys_go_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HOT", 8)  # no word is hot, and few phrases
    check(spark, [("en", t) for t in texts(4, 80)])


def test_odd_rows(spark):
    long = "a b c d " * 20_000
    check(spark, [("en", None), ("en", ""), (None, "   "), ("fr", ".,;"), ("en", "x y x y x y x y")] * 3 + [("en", long)])
    check(spark, [])
    check(spark, [("en", "one two")])
    check(spark, [("en", "NUL \x00 NUL \x00 NUL \x00 NUL \x00 end")] * 2)


@pytest.mark.parametrize("u", [1, 3, 8, 11, 16])
def test_filters_are_lossless(u):
    dice = np.random.default_rng(u)
    half = 3 * u
    ids = [dice.integers(0, 1 << 2 * u, 4000) for _ in range(3)]
    left, right = qf.permute(*qf.pack(*ids, u), half)
    assert all((a == b).all() for a, b in zip(qf.unpack(*qf.unpermute(left, right, half), u), ids))
    n = dice.integers(1, 600, 4000)
    parts = []
    for part in (slice(0, 1500), slice(1500, 4000), slice(0, 10), slice(0, 0)):
        l, r, k = qf.summed(left[part], right[part], n[part])
        for range_ in range(4):
            of = l >> np.uint64(half - 2) == range_
            f = qf.QuotientFilter.build(l[of], r[of], k[of], half, 2)
            back = f.entries(range_)
            assert all((a == b).all() for a, b in zip(back, (l[of], r[of], k[of])))
            parts.append((range_, f))
    want = Counter()
    for part in (slice(0, 1500), slice(1500, 4000), slice(0, 10)):
        for key, k in zip(zip(*(i[part].tolist() for i in ids)), n[part].tolist()):
            want[key] += k
    found = {}
    for range_ in range(4):
        l, r, k = qf.merged([f for g, f in parts if g == range_], range_)
        order = np.lexsort((r, l))
        assert (order == np.arange(len(l))).all()
        found |= dict(zip(zip(*(x.tolist() for x in qf.unpack(*qf.unpermute(l, r, half), u))), k.tolist()))
    assert found == want


def test_filters_are_compact():
    dice = np.random.default_rng(5)
    l, r, k = qf.summed(*qf.permute(*qf.pack(*(dice.integers(1, 1 << 16, 100_000) for _ in range(3)), 8), 24), np.ones(100_000, np.int64))
    f = qf.QuotientFilter.build(l, r, k, 24, 0)
    assert len(f.occupied + f.runends + f.remainders + f.counters) < 5.5 * len(l)


def test_ids_beyond_the_filter_are_refused():
    with pytest.raises(ValueError):
        qf.half_bits(1 << 32)
