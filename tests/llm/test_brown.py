"""The class language model against plain sums, its probabilities, and its exchange step."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from runsift.llm import brown, word_shards as ws


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def plain(rows):
    """Scores if all exchanged words are of one class."""
    train = [tokens(t) for k, t in rows if not held(k)]
    c = Counter(w for t in train for w in t)
    total, types = sum(c.values()), len(c)

    def of(w):
        if w == "\n":
            return "end"
        if not c[w]:
            return None
        return "often" if c[w] >= 5 else int(math.log2(c[w]))

    pairs = Counter((of(a), of(b)) for t in train for a, b in zip(["\n", *t], t))
    before, after = Counter(), Counter()
    for (a, b), n in pairs.items():
        before[a] += n
        after[b] += n
    size = brown.ALL
    out = []
    for k, t in rows:
        words = tokens(t)
        base = sum(math.log10((c[w] + 1) / (total + types + 1)) for w in words)
        score, last = 0.0, "end"
        for w in words if total else []:
            g = of(w)
            novel = (pairs[last, 0] + size * (after[0] + 0.5) / (total + 1)) / (before[last] + size)
            if g is None:
                score += math.log10(novel)
            else:
                move = (pairs[last, g] + size * after[g] / total) / (before[last] + size)
                score += math.log10((1 - novel) * move * c[w] / after[g])
            last = 0 if g is None else g
        out.append((k, held(k), len(words), sum(c[w] > 0 for w in words), total, base, score))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(k, t, True, 1) for k, t in rows], "doc_id bigint, text string, counted boolean, n int")
    found = brown.score(df, **options).drop("perplexity")
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


def same(found, want):
    want = sorted(want, key=repr)
    assert len(found) == len(want)
    key = lambda r: (repr(r[0]), *r[1:4], round(r[5], 6))
    for a, b in zip(sorted(found, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-8) and a[6] == pytest.approx(b[6], abs=1e-8)


def texts(seed, n):
    dice = random.Random(seed)
    return ["".join(dice.choice(["The", "a", "OF", "cat", f"x{dice.randrange(40)}", "É"]) + dice.choice([" ", "\n", "\t "]) for _ in range(dice.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("shard", [1 << 21, 50])
def test_sums_and_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(ws, "SHARD_TOKENS", shard)
    monkeypatch.setattr(brown, "CLASSES", 1)
    monkeypatch.setattr(brown, "ALL", 2 + brown.BANDS)
    rows = list(enumerate(texts(1, 90))) + [(200, None), (201, ""), (202, " \n "), (None, "the cat"), (3, "again a cat"), (3, "again a cat"), (203, "of " * 30_000)]
    same(run(spark, rows, rounds=0), plain(rows))


def test_all_words_that_occur_five_times_are_exchanged(spark, monkeypatch):
    # Once words of less than this share of the tokens were left out, so that more input meant fewer words.
    monkeypatch.setattr(brown, "SHARE", 8, raising=False)
    monkeypatch.setattr(brown, "CLASSES", 1)
    monkeypatch.setattr(brown, "ALL", 2 + brown.BANDS)
    rows = list(enumerate(texts(8, 90)))
    same(run(spark, rows, rounds=0), plain(rows))


@pytest.mark.parametrize("shard", [1 << 21, 300])
def test_classes_by_joins_are_those_of_a_vector(spark, monkeypatch, shard):
    monkeypatch.setattr(ws, "SHARD_TOKENS", shard)
    dice = random.Random(9)
    sets = [[f"{p}{k}" for k in range(40)] for p in "abc"]
    rows = [(k, " ".join(dice.choice(sets[i % 3]) for i in range(60))) for k in range(120)] + [(70, "rare words"), (None, None)]
    by_vector = run(spark, rows, rounds=3)
    monkeypatch.setattr(brown, "SENT_WORDS", 3)
    same(run(spark, rows, rounds=3), by_vector)
    assert by_vector != run(spark, rows, rounds=0)


def test_nothing_to_learn_from(spark):
    out = [k for k in range(60) if held(k)]
    assert run(spark, []) == []
    assert [(r[0], r[4], r[5], r[6]) for r in run(spark, [(out[0], "a b")])] == [(out[0], 0, 0.0, 0.0)]
    inside = next(k for k in range(60) if not held(k))
    only = run(spark, [(inside, None), (out[0], "new words")])
    assert {r[0]: r[2:5] for r in only} == {inside: (1, 1, 1), out[0]: (3, 1, 1)}
    assert all(r[6] <= 0 and math.isfinite(r[6]) for r in only)


def test_probabilities_sum_to_one():
    dice = np.random.default_rng(3)
    pairs = dice.integers(0, 50, (brown.ALL, brown.ALL))
    pairs[:, 7] = pairs[7] = 0
    pairs[dice.integers(0, brown.ALL, 10)] = 0
    steps = brown.BrownModel(np.zeros(1, np.uint8), pairs).steps()
    after = pairs.sum(0)
    sums = (10 ** steps[: brown.ALL, : brown.ALL] * after).sum(1) + 10 ** steps[: brown.ALL, brown.ALL]
    assert np.allclose(sums, 1)
    assert (steps[brown.ALL] == steps[brown.CLASSES]).all()


def test_best_class_is_that_of_a_plain_search(monkeypatch):
    monkeypatch.setattr(brown, "WEIGHED", 7)
    dice = np.random.default_rng(4)
    pairs = dice.integers(0, 30, (brown.ALL, brown.ALL))
    words = 9
    own = dice.integers(0, brown.CLASSES, words)
    near = {w: {int(k): int(n) for k, n in zip(dice.choice(2 * brown.ALL, 12, replace=False), dice.integers(1, 9, 12))} for w in range(words)}
    flat = [(w, k, n) for w in range(words) for k, n in sorted(near[w].items())]
    best = brown.better_classes(pairs, own, *(np.array(c) for c in zip(*flat)))

    def x(v):
        return v * math.log(v) if v > 1 else 0.0

    for w in range(words):
        gains = []
        for c in range(brown.CLASSES):
            gain = 0.0
            ahead = behind = 0
            for k, n in near[w].items():
                cell = int(pairs[k, c] if k < brown.ALL else pairs[c, k - brown.ALL])
                cell = max(cell - n, 0) if c == own[w] else cell
                gain += x(cell + n) - x(cell)
                ahead, behind = (ahead + n, behind) if k < brown.ALL else (ahead, behind + n)
            for total, size in ((int(pairs[:, c].sum()), ahead), (int(pairs[c].sum()), behind)):
                total = max(total - size, 0) if c == own[w] else total
                gain -= x(total + size) - x(total)
            gains.append(gain)
        assert gains[best[w]] == pytest.approx(max(gains))


def test_classes_find_order_and_lower_perplexity(spark):
    dice = random.Random(6)
    sets = [[f"{p}{k}" for k in range(30)] for p in "abc"]
    rows = [(k, " ".join(dice.choice(sets[i % 3]) for i in range(60))) for k in range(200)]
    without, found = run(spark, rows, rounds=0), run(spark, rows, rounds=4)
    total = lambda rows, of, at: sum(r[at] for r in rows if r[1] is of)
    assert total(found, True, 6) > total(without, True, 6)
    assert total(found, True, 6) > 1.1 * total(found, True, 5)  # scores are below zero
    assert run(spark, rows, rounds=4) == found
