"""Toxicity, decontamination, shards, URL verdicts and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from runsift.llm import decontaminate, sharding, simhash, toxicity, url_filter

WORDS = "the of and river stone walk green light table under seven older house quick paper".split()


def prose(dice, n):
    return " ".join(dice.choice(WORDS) for _ in range(n))


# -- toxicity ----------------------------------------------------------------------------------
def labelled(seed=1, n=240):
    dice = random.Random(seed)
    texts, toxic = [], []
    for k in range(n):
        words = prose(dice, dice.randint(5, 60)).split()
        bad = k % 4 == 0
        if bad:
            words.insert(dice.randint(0, len(words)), "grub" + dice.choice(["lin", "ber", "sock", "tov"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_finds_held_out_documents(spark, documents):
    texts, toxic = labelled()
    docs = documents(texts + [None, ""])
    labels = spark.createDataFrame([(k, y, None) for k, y in enumerate(toxic)] + [(3, None, None), (None, 1, None)], "doc_id bigint, toxic int, score string")
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 30
    assert all(rows[k].predicted == toxic[k] for k in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    assert rows[len(texts)].score == rows[len(texts) + 1].score and rows[len(texts)].predicted == 0
    # Held-out labels change nothing.
    wrong = [(k, 1 - y if k in held else y, None) for k, y in enumerate(toxic)]
    again = toxicity.fit(docs, spark.createDataFrame(wrong, labels.schema))
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias


def test_toxicity_without_use_of_labels(spark, documents):
    docs = documents(["a b c", "d"])
    schema = "doc_id bigint, toxic int"
    for rows in ([], [(0, None)], [(0, 0), (1, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, schema))
        assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0, 0]
    assert toxicity.score(documents([]), model).count() == 0


def test_grams_are_taken_from_the_whole_text(monkeypatch):
    text = prose(random.Random(2), 400)
    whole = toxicity.gram_ids(text)
    monkeypatch.setattr(toxicity, "STRETCH", 37)
    assert np.array_equal(whole, toxicity.gram_ids(text))


# -- decontamination ---------------------------------------------------------------------------
ITEM = "A train goes 60 km from Paris to Lyon in 2 hours at noon. How fast is the train to Lyon, then?"


def leaks(spark, docs, items):
    d = spark.createDataFrame([(k, t, 0) for k, t in enumerate(docs)], "doc_id bigint, text string, hash int")
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.leaks(d, b).collect()}, d, b


def test_templates_and_slots(spark):
    docs = [
        ITEM,
        "Listen, friend. " + ITEM.replace("60", "90").replace("Paris", "Bonn").replace("Lyon", "Ulm").replace("km", "miles") + " So he said.",
        ITEM.replace("to Lyon in 2", "to Ulm in 5"),  # one value of the item, two of the document
        ITEM.replace("Paris", "Lyon").replace("2", "5"),  # two values of the item, one of the document
        prose(random.Random(3), 300),
        None,
        "",
        " ".join(ITEM.split()[:5]),
        (prose(random.Random(4), 50) + " ") * 30 + ITEM + " " + ITEM,
    ]
    found, d, b = leaks(spark, docs, [ITEM, "too short", None])
    assert sorted(found) == [(0, 0), (1, 0), (8, 0)]
    assert [found[k, 0].exact for k in (0, 1, 8)] == [True, False, True]
    kept = [r.doc_id for r in decontaminate.decontaminate(d, b).collect()]
    assert sorted(kept) == [2, 3, 4, 5, 6, 7]


def test_part_of_an_item(spark):
    dice = random.Random(5)
    item = " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(60))
    words = item.split()
    docs = [" ".join(words[10:23]), " ".join(words[10:22]), prose(dice, 30) + " " + " ".join(words[2:]) + " " + prose(dice, 9), " ".join(words[::-1])]
    found, _, _ = leaks(spark, docs, [item, item])
    assert sorted(found) == [(0, 0), (0, 1), (2, 0), (2, 1)]
    assert found[0, 0].longest_words == 13


def test_nothing_to_compare(spark):
    assert leaks(spark, [ITEM], [])[0] == {}
    assert leaks(spark, [], [ITEM])[0] == {}


# -- shards ------------------------------------------------------------------------------------
def check_law(rows, texts, shards):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and {r.law for r in rows} <= {"rows"}
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(sizes) <= set(range(shards))
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 8, zlib.crc32(body))


def cut(rows, texts):
    """Documents that are not with the most of their group."""
    by_text = defaultdict(Counter)
    for r in rows:
        if texts[r.doc_id] is not None:
            by_text[texts[r.doc_id]][r.shard] += 1
    return sum(sum(c.values()) - max(c.values()) for c in by_text.values())


def test_shards_are_even_and_keep_groups_together(documents):
    dice = random.Random(6)
    texts = [f"single {k}" for k in range(300)] + [f"group {dice.randint(0, 40)}" for _ in range(150)] + [None, ""]
    rows = sharding.shard(documents(texts), shards=8).collect()
    check_law(rows, texts, 8)
    # A few of the large groups may lose their race for room.
    assert cut(rows, texts) <= 15


def test_a_group_larger_than_a_shard_is_split_evenly(documents):
    texts = ["same"] * 120 + [f"single {k}" for k in range(90)] + ["pair", "pair"]
    check_law(sharding.shard(documents(texts), shards=5).collect(), texts, 5)
    only = ["same"] * 47
    check_law(sharding.shard(documents(only), shards=5).collect(), only, 5)


def test_small_and_empty_tables(documents):
    for texts in ([], ["x"], ["x", "x"]):
        check_law(sharding.shard(documents(texts), shards=4).collect(), texts, 4)


# -- URLs --------------------------------------------------------------------------------------
def test_hosts_paths_and_rules(spark):
    urls = [
        ("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/x", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("http://example.com/en", "example.com", "/en", "com/", "allow"),
        ("x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("https://b.net/es/?x", "b.net", "/es/", "net/es/", "block"),
        ("https://b.net/de/", "b.net", "/de/", None, "block"),
        ("https://c.net?/es/", "c.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://İ.COM/a://b", "İ.com", "/a://b", "com/", "allow"),
        ("http://x.org/a#b", "x.org", "/a", None, "allow"),
    ]
    rows = [(k, u[0], None, "x") for k, u in enumerate(urls)] + [(99, "https://b.net/es/2", "", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, rule string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert [found[k] for k in range(len(urls))] == [u[1:] for u in urls]
    assert url_filter.judge(pages.limit(0)).count() == 0


def plain_propagation(edges, seeds, damping, rounds):
    """(host, trust, distrust) by loops."""
    out, into = defaultdict(dict), defaultdict(dict)
    for (a, b), n in edges.items():
        out[a][b] = n
        into[b][a] = n
    state = dict(seeds)
    for _ in range(rounds):
        new = {h: [(1 - damping) * t, (1 - damping) * d] for h, (t, d) in seeds.items()}
        for h, (t, d) in state.items():
            for way, value, column in ((out, t, 0), (into, d, 1)):
                for other, n in way[h].items():
                    new.setdefault(other, [0.0, 0.0])[column] += damping * value * n / sum(way[h].values())
        state = {h: tuple(v) for h, v in new.items()}
    return state


def test_propagation_follows_links(spark):
    dice = random.Random(7)
    hosts = [f"h{k}.org" for k in range(20)]
    edges = Counter((dice.choice(hosts), dice.choice(hosts)) for _ in range(60))
    edges = {e: n for e, n in edges.items() if e[0] != e[1]}
    seeds = {h: (0.0, 0.0) for h in hosts} | {"h0.org": (0.5, 0.0), "h1.org": (0.5, 0.0), "h2.org": (0.0, 1.0)}
    e = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "a string, b string, n bigint")
    s = spark.createDataFrame([(h, t, d) for h, (t, d) in seeds.items()], "host string, trust double, distrust double")
    found = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(e, s, 0.85, 6, 0.0).collect()}
    want = plain_propagation(edges, seeds, 0.85, 6)
    assert set(found) == set(want)
    assert all(abs(found[h][i] - want[h][i]) < 1e-12 for h in want for i in (0, 1))


def test_trust_goes_along_a_long_chain(spark):
    n = 50
    pages = [(0, "http://bad.net/es/", "")] + [(k, f"http://h{k}.org/", f"<a href='http://{'bad.net' if k == 1 else f'h{k - 1}.org'}/'>") for k in range(1, n + 1)]
    pages += [(100, "http://h7.org/x", None), (100, "http://h7.org/y", ""), (None, "http://h50.org/z", None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = url_filter.judge(df).collect()
    assert len(rows) == len(pages) and {r.verdict for r in rows} == {"block"}


def test_a_bound_on_steps_is_no_cap(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "a string, b string, n bigint")
    s = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    found = {r.host: r.trust for r in url_filter.propagate(e, s, 0.5, None, 1e-9).collect()}
    assert abs(found["a"] - 2 / 3) < 1e-8 and abs(found["b"] - 1 / 3) < 1e-8


def test_links_decide_where_no_rule_fits(spark):
    pages = [
        (1, "http://bad.net/es/", "<a href='http://x.org'>"),
        (2, "http://bad.net/fr/", None),
        (3, "http://links-to-bad.org/a", '<a href="https://BAD.net/q"> <a href=/local> <img src=//bad.net/i>'),
        (4, "http://good.com/", '<a href="http://liked.org/">'),
        (5, "http://liked.org/", ""),
        (6, "http://alone.org/", "<p>"),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    found = {r.page_id: r.verdict for r in url_filter.judge(df).collect()}
    assert found == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


# -- pipeline ----------------------------------------------------------------------------------
def test_pipeline_decisions(spark, tmp_path):
    texts, toxic = labelled(8, 200)
    dice = random.Random(9)
    clean = prose(dice, 120)
    extra = [clean, clean, clean + " mail jo@host.example now", prose(dice, 40) + ". " + ITEM, None, "", ""]
    rows = [(k, t, "en", "s", len(t) if t is not None else None) for k, t in enumerate(texts + extra)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "benchmark", "pii", "bpe"]

    n = len(texts)
    kept = {k: (texts + extra)[k] for k in range(n + len(extra)) if k >= n or not toxic[k]}
    docs = spark.createDataFrame([(k, t) for k, t in kept.items()], "doc_id bigint, text string")
    firsts = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert set(out) == firsts - {n + 3}
    assert n + 1 not in out and n + 5 not in out and n + 6 not in out and n + 4 in out
    assert "jo@" not in "".join(r.text or "" for r in out.values())
    assert all(r.n_tokens == len(r.ids) for r in out.values())


@pytest.mark.parametrize("rows", [[], [(None, ITEM), (None, None), (None, ""), (7, ITEM), (7, "a mail to jo@host.example " * 3000), (8, "x")]])
def test_pipeline_takes_odd_tables(spark, tmp_path, rows):
    names = "_whole string, _row bigint, _gone string, _dirty int, _first int"
    docs = [(k, t, "en", "s", len(t or ""), "w", 1, "g", 2, 3) for k, t in rows]
    spark.createDataFrame(docs, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {names}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(8, 0)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Of the two that are empty one stays; both that hold the item go, whatever their keys.
    assert sorted((r.doc_id is None, r.doc_id, len(r.text or "") > 9) for r in out) == ([] if not rows else [(False, 7, True), (False, 8, False), (True, None, False)])
    assert all((r._whole, r._row, r._gone, r._dirty, r._first) == ("w", 1, "g", 2, 3) for r in out)
    assert "jo@" not in "".join(r.text or "" for r in out)
