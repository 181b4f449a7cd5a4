"""Near-duplicates and repeated strings against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from runsift.llm import simhash, suffix_array, suffix_dedup
from runsift.llm.components import components


# -- components --------------------------------------------------------------------------------
def groups(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    dice = random.Random(1)
    chains = [(k, k + 1) for k in range(60)] + [(200, 100 + k) for k in range(30)] + [(5, 5), (300, 301), (301, 300)]
    edges = chains + [(dice.randint(400, 480), dice.randint(400, 480)) for _ in range(50)]
    df = spark.createDataFrame(edges + [(None, 3), (7, None)], "a bigint, b bigint")
    want = {k: v for k, v in groups(edges).items() if k != v}
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


# -- SimHash -----------------------------------------------------------------------------------
def brute_print(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 3]
    return {i: groups(edges).get(i, i) for i in ids}


def varied_texts(seed=2):
    dice = random.Random(seed)
    words = ["ab", "Cd", "éf", "gh,", "i", "JK", "l.m", "no"]
    bases = [" ".join(dice.choice(words) for _ in range(dice.randint(1, 120))) for _ in range(25)]
    out = [None, "", " \n", "one", "One TWO", "one\ttwo", "Ünö"]
    for base in bases:
        for _ in range(4):
            w = base.split()
            w[dice.randrange(len(w))] = dice.choice(words)
            out += [base, "\n".join(w)]
    return out


def test_near_duplicates_are_the_components(documents):
    texts = varied_texts()
    prints = {k: brute_print(t) for k, t in enumerate(texts)}
    want = brute_components(prints)
    rows = simhash.near_duplicates(documents(texts)).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == want
    kept = [r.doc_id for r in simhash.keep_one(documents(texts)).collect()]
    assert sorted(kept) == sorted(set(want.values()))
    assert simhash.near_duplicates(documents([])).count() == 0


def test_near_duplicates_with_bad_keys(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, "x y z"), (2, "x y w"), (1, "q r s t u"), (None, "only here it stands")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    by_print = {}
    for key, text in rows:
        by_print.setdefault(brute_print(text), []).append(key)
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(by_print) == 5
    assert sorted(r.text for r in kept) == sorted({t for _, t in rows})


def test_every_pair_within_three_bits_meets(spark):
    dice = random.Random(3)
    prints = set()
    for _ in range(12):
        base = dice.getrandbits(64)
        prints.add(base)
        for n in (1, 2, 3, 3, 3, 4):
            prints.add(base ^ sum(1 << b for b in dice.sample(range(64), n)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    rows = simhash.links(spark.createDataFrame(signed, "fp bigint")).collect()
    have = groups([(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in rows])
    want = groups([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    assert {frozenset(k for k in have if have[k] == v) for v in have.values()} == {
        frozenset(k for k in want if want[k] == v) for v in want.values()
    }


def test_crowded_keys_give_the_same_classes(monkeypatch):
    chance = np.random.default_rng(0)
    for trial in range(12):
        mask, bits = simhash._masks()[trial % 3]
        rest = [b for b in range(64) if not mask >> b & 1]
        base, members = int(chance.integers(0, 2**63)), set()
        for _ in range(150):
            value = base ^ (1 << int(chance.choice(bits[:6])) if chance.random() < 0.7 else 0)
            for b in chance.choice(rest, chance.integers(0, 8), replace=False):
                value ^= 1 << int(b)
            members.add(value)
        prints = np.array(sorted(members), np.uint64)
        want = groups([(int(a), int(b)) for i, a in enumerate(prints) for b in prints[:i] if int(a ^ b).bit_count() <= 3])
        for most in (10_000, 1):
            monkeypatch.setattr(simhash, "PAIRED", most)
            assert [int(x) for x in simhash.linked(prints, mask)] == [want.get(int(p), int(p)) for p in prints]


# -- suffix arrays -----------------------------------------------------------------------------
def test_suffix_arrays_and_common_prefixes():
    chance = np.random.default_rng(0)
    for _ in range(400):
        t = np.r_[chance.integers(1, 2 + chance.integers(0, 5), chance.integers(0, 60)), 0].astype(np.uint8)
        data = t.tobytes()
        sa = suffix_array.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: data[i:])
        ends, end = np.empty(len(t), int), len(t) - 1
        for i in reversed(range(len(t))):
            end = i if t[i] <= 1 else end
            ends[i] = end
        limit = ends - np.arange(len(t))
        before, common = suffix_array.common_prefixes(t, sa, limit)
        for i in range(len(t)):
            if before[i] >= 0:
                n = 0
                while max(i, before[i]) + n < len(t) and data[i + n] == data[before[i] + n]:
                    n += 1
                assert min(n, limit[i]) == common[i]


def brute_removal(texts, width):
    bodies = [(t or "").encode() for t in texts]
    seen = {}
    for body in bodies:
        for i in range(len(body) - width + 1):
            seen[body[i : i + width]] = seen.get(body[i : i + width], 0) + 1
    out = []
    for body in bodies:
        covered = [False] * len(body)
        for i in range(len(body) - width + 1):
            if seen[body[i : i + width]] > 1:
                covered[i : i + width] = [True] * width
        runs = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        kept = bytes(b for b, c in zip(body, covered) if not c)
        out.append((len(body), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts(seed):
    dice = random.Random(seed)
    text = lambda n: "".join(dice.choice("abé ß\n") for _ in range(n))
    shared = [text(n) for n in (15, 30, 60, 200)]
    out = [None, "", "short", "a" * 500, shared[3], shared[3], shared[3][:25] + shared[3][:25]]
    for _ in range(60):
        out.append(text(dice.randint(0, 80)) + dice.choice(shared)[dice.randint(0, 20) :] + text(dice.randint(0, 80)))
    return out


def removed(docs, **options):
    rows = suffix_dedup.remove_repeats(docs, width=24, gram=8, **options).collect()
    for r in rows:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
        assert r.n_removed == sum(s.end - s.start for s in r.spans)
    return rows


def test_repeats_are_what_brute_force_removes(documents):
    texts = repeated_texts(1)
    want = brute_removal(texts, 24)
    for crowd in (1000, 1):
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed(documents(texts), crowd=crowd)}
        assert found == dict(enumerate(want))


def test_repeats_with_repeated_and_null_keys(spark):
    texts = repeated_texts(2)
    docs = spark.createDataFrame([(k % 3 or None, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    found = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed(docs))
    assert found == sorted(brute_removal(texts, 24))
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_anchors_depend_on_the_window_alone():
    dice = random.Random(4)
    window = bytes(dice.choice(b"abcd") for _ in range(24))
    places = set()
    for _ in range(20):
        left, right = (bytes(dice.choice(b"abcd") for _ in range(dice.randint(0, 60))) for _ in range(2))
        at, _ = suffix_dedup.anchors(left + window + right, 24, 8)
        inside = {int(a) - len(left) for a in at if len(left) <= a <= len(left) + 16}
        places = places & inside if places else inside
    assert places
