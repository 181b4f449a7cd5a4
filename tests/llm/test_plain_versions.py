"""Operators whose other tests look at quality or laws, against plain versions of their method."""

import math
import random
import zlib

import numpy as np
import pytest

from runsift.llm import common, sharding, suffix_array, suffix_dedup, toxicity

# -- toxicity: ratios, choice of features and the fit ----------------------------------------------
WORDS = "the of and river stone walk green light table under seven older house quick paper".split()


def labelled(seed, n):
    dice = random.Random(seed)
    texts = [" ".join(dice.choice(WORDS) for _ in range(dice.randint(1, 25))) for _ in range(n)]
    toxic = [int(dice.random() < 0.3) for _ in range(n)]
    return [t + " grubl" if y and dice.random() < 0.8 else t for t, y in zip(texts, toxic)], toxic


def plain_fit(texts, toxic, features, penalty=1.0, rounds=80, pace=0.05):
    known = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 4 != 2]
    grams = {k: set(toxicity.gram_ids(texts[k]).tolist()) for k in known}
    n1 = sum(toxic[k] for k in known)
    n0 = len(known) - n1
    share = (n1 + 0.5) / (len(known) + 1)
    ranked = []
    for f in set().union(*grams.values()):
        t = sum(f in grams[k] for k in known if toxic[k])
        c = sum(f in grams[k] for k in known if not toxic[k])
        if t + c >= 3:
            r = math.log((t + 1) / (n1 + 2)) - math.log((c + 1) / (n0 + 2))
            ranked.append((-abs(r / math.sqrt(1 / (t + 1) + 1 / (c + 1))), f, r))
    chosen = sorted((f, r) for _, f, r in sorted(ranked)[:features])
    x = np.array([[r * (f in grams[k]) for f, r in chosen] for k in known])
    y = np.array([toxic[k] for k in known], float)
    weight = np.where(y > 0, share / n1, (1 - share) / n0) * len(y)
    w, b = np.zeros(len(chosen)), math.log(share / (1 - share))
    seen, seen_b = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(rounds):
        miss = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        slope, slope_b = x.T @ miss + penalty * w, miss.sum()
        seen, seen_b = seen + slope**2, seen_b + slope_b**2
        w, b = w - pace * slope / np.sqrt(seen), b - pace * slope_b / math.sqrt(seen_b)
    return [f for f, _ in chosen], w * np.array([r for _, r in chosen]), b


def test_the_fit_is_that_of_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 60)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    texts, toxic = labelled(3, 90)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    features, weights, bias = plain_fit(texts, toxic, 60)
    assert model.features.tolist() == features
    assert np.allclose(model.weights, weights, atol=1e-9) and model.bias == pytest.approx(bias, abs=1e-9)


def test_of_a_repeated_id_the_least_text_is_learnt(spark):
    texts, toxic = labelled(4, 60)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")
    rows = [(k, t) for k, t in enumerate(texts)]
    more = [(k, "zz " + t) for k, t in rows] + rows + [(None, "x")]
    schema = "doc_id bigint, text string"
    one = toxicity.fit(spark.createDataFrame(rows, schema), labels)
    two = toxicity.fit(spark.createDataFrame(more, schema).repartition(5), labels)
    assert np.array_equal(one.features, two.features) and np.array_equal(one.weights, two.weights)


# -- shards: one round of moves ----------------------------------------------------------------------
def test_groups_move_to_where_most_of_them_are(spark):
    units = [("a", 0, 5, 0), ("a", 1, 2, 1), ("b", 0, 3, 1), ("b", 1, 3, 2), ("c", 0, 1, 2), ("d", 0, 1, 0), ("d", 1, 1, 2)]
    df = spark.createDataFrame(units, "g string, salt int, n bigint, shard int")
    found = {(r.g, r.salt): r.shard for r in sharding.propagate(df, [100, 100, 100], 4).collect()}
    # The larger part attracts; of equal parts the one in the smaller shard.
    assert found == {("a", 0): 0, ("a", 1): 0, ("b", 0): 1, ("b", 1): 1, ("c", 0): 2, ("d", 0): 0, ("d", 1): 0}
    # Shards without room take nothing.
    full = {(r.g, r.salt): r.shard for r in sharding.propagate(df, [0, 0, 0], 4).collect()}
    assert full == {(g, s): shard for g, s, _, shard in units}


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    rows = [(None, "x"), (None, "x"), (1, "x"), (1, "y"), (1, None), (2, "z")] * 3
    out = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=4).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted(
        (k or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in rows
    )
    counts = [sum(r.shard == s for r in out) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(counts[s])) for s in range(4))


# -- suffix arrays that recurse ----------------------------------------------------------------------
def test_periodic_strings_recurse_over_levels(monkeypatch):
    levels = []
    plain = suffix_array.suffix_array

    def counted(t, alphabet=256):
        levels.append(len(t))
        return plain(t, alphabet)

    monkeypatch.setattr(suffix_array, "suffix_array", counted)
    a, b = b"ab", b"abc"
    while len(b) < 6000:
        a, b = b, b + a
    nested = b"x".join([b"ab" * 300] * 20)
    deepest = 0
    for data in (b, nested, b"abracadabra" * 700, (b"aab" * 90 + b"ab" * 90) * 25):
        t = np.r_[np.frombuffer(data, np.uint8), 0].astype(np.uint8)
        levels.clear()
        sa = counted(t)
        rank = np.empty(len(t), np.int64)
        rank[sa] = np.arange(len(t))
        assert sorted(sa.tolist()) == list(range(len(t)))
        # Neighbours in order: first symbol, then the order of what follows.
        x, y = sa[:-1], sa[1:]
        assert ((t[x] < t[y]) | ((t[x] == t[y]) & (rank[np.minimum(x + 1, len(t) - 1)] < rank[np.minimum(y + 1, len(t) - 1)]))).all()
        deepest = max(deepest, len(levels))
    assert deepest > 2


# -- hot keys -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("threshold", [0, 5, 10**9])
def test_joins_by_parts_give_what_a_join_gives(spark, threshold):
    dice = random.Random(1)
    rows = spark.createDataFrame([(dice.randrange(6), dice.choice([None, "a", "b"]), k) for k in range(200)], "k int, s string, _hit int")
    table = spark.createDataFrame([(k, s, k * 10) for k in range(5) for s in "ab"], "k int, s string, v int")
    counts = rows.groupBy("k", "s").count()
    table = table.join(counts, ["k", "s"])
    from pyspark.sql import functions as F

    found = common.joined_by_parts(rows, table, ["k", "s"], F.col("count") > threshold)
    want = rows.join(table, ["k", "s"])
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_repeats_with_hot_anchors_and_with_none(documents, monkeypatch):
    dice = random.Random(5)
    line = "one very common line of text "
    texts = [line + "".join(dice.choice("abcd ") for _ in range(40)) for _ in range(60)] + [line * 4] * 20

    def found():
        rows = suffix_dedup.remove_repeats(documents(texts), width=24, gram=8, crowd=10).collect()
        return sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in rows)

    first = found()
    monkeypatch.setattr(suffix_dedup, "HOT", 0)
    assert found() == first
