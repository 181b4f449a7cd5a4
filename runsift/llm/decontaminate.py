"""Benchmark passages in documents, also with other numbers, names and units put in.

Texts become templates: words are lower-cased and stripped of punctuation, numbers, units behind a
number, and names (capitalised inside a sentence) become typed placeholders. Windows of WORDS
template words are hashed, and windows of documents join those of the benchmark by hash. A pair of
document and item counts by shift, the distance of the two places, so that windows of one passage
add up. Two conditions make it a leak: at least COVERED of the item's windows stand in the document
at one shift, or LONGEST words of it in a row; and the slots are consistent: each value of the item
(a number, a name) stands for one value of the document throughout, and the other way round.

Names that stand side by side are one placeholder. A capitalised word elsewhere (first in a
sentence, behind a number, quote or line break) may be a name: windows that touch one have a second
hash with it as a name. A leak is looked for in several ways, and one that holds is enough: plain
windows; those and the second hashes; with `verbatim`, only windows without a changed slot, which
need no placeholder and so no test of consistency. Each way is tried at single shifts and with the
windows of shifts within NEARBY words added up.

There are two passes over the documents. The first one looks only for documents that share a window
with the benchmark: placeholders are put in by patterns and hashes are compared. The second one
does the whole work on those documents. The first pass makes every hash of the second, so nothing
is lost by it.

Only DataFrame functions are used: no Python runs on the executors.

Null texts count as empty. Items and documents with fewer words than a window have no windows and
never match. Repeated items are items of their own. In `leaks`, rows that repeat a doc_id, or have
none, are one document. `decontaminate` judges every row by itself. An empty benchmark gives no
rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift.llm.common import free_name, has_plain_key, sent, whole_text, written

WORDS, COVERED, LONGEST = 5, 0.8, 13
#: Words put in or left out between two parts of a passage.
NEARBY = 4
#: Windows of the benchmark that may be sent to all executors; beyond, both sides are shuffled, and
#: a hash that very many documents hold is spread over SALTS tasks.
SENT_WINDOWS, SALTS = 200_000, 16

UNITS = (
    "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches yd l ml s sec min h hr hour hours day days "
    "week weeks month months year years dollar dollars usd eur euro euros pound pounds cent cents percent "
    "degree degrees mph kmh kph v w kw kwh hz gb mb kb"
).split()

#: Placeholders; they hold characters that no template word has.
NUMBER, UNIT, NAME = "<n>", "<u>", "<p>"


def marked(text: Column) -> Column:
    """The words of a text, one space between, with a mark: a number, a name, or a word in lower
    case.

    `=` begins a number's word, `^` a name's, `~` that of another word with a capital; `|` joins
    names side by side. Marks and punctuation inside words are removed first. A name starts with a
    capital and follows, in one sentence, a word in lower case."""
    # A capital behind a lower-case letter or comma and one space: inside a sentence. Every pattern
    # begins with what is rare.
    text = F.translate(text, "^=~|", "    ")
    text = F.regexp_replace(text, r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll},] )", "^")
    text = F.regexp_replace(text, r"(\^[\p{L}\p{M}]++) (?=\^)", "$1|")
    text = F.regexp_replace(text, r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{N}\p{M}^])", "~")
    # The point or comma of a number stays in it.
    text = F.regexp_replace(text, r"(?=\p{N})(?<![\p{L}\p{N}])", "=")
    junk = r"(?:(?<!\p{N})[.,]|[.,](?!\p{N})|[^\p{L}\p{N}\p{M}^=~|., ])"
    return F.trim(F.regexp_replace(F.lower(text), f" *+(?:{junk} *+)++|  ++", " "))


def raw_words(text: Column) -> Column:
    return F.split(marked(text), " ")


def templates(rows: DataFrame, text: str) -> DataFrame:
    """rows with `raw` (marked words), `words` (the same with placeholders) and `maybe` (places of
    words that may be names)."""
    raw = F.filter(raw_words(whole_text(text)), lambda w: ~w.isin("", "^", "=", "~", "|"))
    units = F.array(*[F.lit(u) for u in UNITS])

    def placed(w: Column, i: Column) -> Column:
        before = F.get(F.col("raw"), i - 1)
        return (
            F.when(w.startswith("="), NUMBER)
            .when(w.startswith("^"), NAME)
            .when(before.startswith("=") & F.array_contains(units, F.ltrim(w, F.lit("~"))), UNIT)
            .otherwise(F.ltrim(w, F.lit("~")))
        )

    return rows.withColumn("raw", raw).withColumn(
        "words",
        # Few texts hold a number or a name; the others need no second look.
        F.when(F.exists("raw", lambda w: w.startswith("=") | w.startswith("^") | w.startswith("~")), F.transform("raw", placed)).otherwise(F.col("raw")),
    ).withColumn(
        # Of `raw` alone: a single use of `words` would be computed again for each word.
        "maybe", F.filter(F.transform("raw", lambda w, i: F.when(w.startswith("~"), i)), lambda i: i.isNotNull())
    )


def windows(rows: DataFrame, key: str, place: str, slots: str, words: int) -> DataFrame:
    """key, hash, place (from 0), slots (the words behind placeholders and their offsets, null if
    none) of every window; windows with words that may be names once more with these as names, and
    `named` is true there."""
    n = F.size("words") - words + 1
    has_slots = F.exists("words", lambda w: w.isin(NUMBER, UNIT, NAME))

    def window(i: Column) -> Column:
        part = F.slice("words", i + 1, words)
        kept = F.when(
            F.col("_slotted") & F.exists(part, lambda w: w.isin(NUMBER, UNIT, NAME)),
            F.transform(part, lambda w, k: F.when(w.isin(NUMBER, UNIT, NAME), F.get(F.col("raw"), i + k)).otherwise("")),
        )
        return F.struct(F.xxhash64(part).alias("hash"), i.alias(place), kept.alias(slots), F.lit(False).alias("named"))

    def second(i: Column) -> Column:
        part = F.transform(
            F.slice("words", i + 1, words), lambda w, k: F.when(F.get(F.col("raw"), i + k).startswith("~") & (w != UNIT), NAME).otherwise(w)
        )
        kept = F.transform(part, lambda w, k: F.when(w.isin(NUMBER, UNIT, NAME), F.translate(F.get(F.col("raw"), i + k), "~", "^")).otherwise(""))
        return F.struct(F.xxhash64(part).alias("hash"), i.alias(place), kept.alias(slots), F.lit(True).alias("named"))

    touched = F.array_distinct(
        F.flatten(F.transform("maybe", lambda p: F.sequence(F.greatest(p - words + 1, F.lit(0)), F.least(p, F.size("words") - words))))
    )
    every = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), window))
    again = F.when(n > 0, F.transform(touched, second))
    every = F.when((n > 0) & (F.size("maybe") > 0), F.concat(every, again)).otherwise(every)
    return (
        rows.withColumn("_slotted", has_slots).select(key, F.explode(every).alias("w"))
        .select(key, "w.hash", f"w.{place}", f"w.{slots}", "w.named")
    )


def touched(docs: DataFrame, hashes: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """The keys of documents with a window whose hash is among `hashes` (each once): with its
    possible names as plain words or as names."""
    units = f"(=(?<=(?: |^)=)[^ ]*+) ~?(?:{'|'.join(UNITS)})(?= |$)"

    def replaced(mark: str, pattern: str, by: str) -> Column:
        return F.when(F.contains("_t", F.lit(mark)), F.regexp_replace("_t", pattern, by)).otherwise(F.col("_t"))

    n = F.size("_w") - words + 1
    names = [f"w{k}" for k in range(words)]
    # Places are exploded, and words are looked up in the array: behind it everything is compiled.
    # A filter on the number of words would have the text split twice.
    rows = (
        docs.select(F.col(key).alias("doc"), marked(whole_text(text)).alias("_t"))
        .withColumn("_t", replaced("=", units, f"$1 {UNIT}"))
        .withColumn("_t", replaced("=", r"=(?<=(?: |^)=)[^ ]*+", NUMBER))
        .withColumn("_t", replaced("^", r"\^(?<=(?: |^)\^)[^ ]*+", NAME))
        .select("doc", F.split("_t", " ").alias("_w"))
        .select("doc", "_w", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("_i"))
        .select("doc", *[F.get("_w", F.col("_i") + k).alias(c) for k, c in enumerate(names)])
    )
    maybe = [F.col(c).startswith("~") for c in names]
    plain = F.xxhash64(*[F.when(m, F.substring(c, 2, 1 << 30)).otherwise(F.col(c)) for c, m in zip(names, maybe)])
    named = F.xxhash64(*[F.when(m, NAME).otherwise(F.col(c)) for c, m in zip(names, maybe)])
    rows = rows.select("doc", plain.alias("plain"), F.when(reduce(or_, maybe), named).alias("named"))
    if hashes.count() <= SENT_WINDOWS:
        one, two = (F.broadcast(hashes.select(F.col("hash").alias(c))) for c in ("_one", "_two"))
        found = (
            rows.join(one, F.col("plain") == F.col("_one"), "left").join(two, F.col("named") == F.col("_two"), "left")
            .where("_one is not null or _two is not null")
        )
    else:
        salts = hashes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        each = rows.select("doc", F.explode(F.array_compact(F.array("plain", "named"))).alias("hash"))
        found = each.withColumn("salt", F.pmod(F.hash("doc", "hash"), F.lit(SALTS))).join(salts, ["hash", "salt"], "left_semi")
    return written(found.select("doc").distinct(), "leaks-touched")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    item: str = "item_id",
    text: str = "text",
    words: int = WORDS,
    covered: float = COVERED,
    longest: int = LONGEST,
    verbatim: bool = True,
) -> DataFrame:
    """One row for each leaked item of a document: key, item, n_windows (of the item in the
    document at the best shift), item_windows, longest_words, n_slots (places with a placeholder
    in the matched windows), exact (no slot value differs). With `verbatim`, a passage that meets a
    condition word by word is a leak whatever differs beside it."""
    items = templates(benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")), "text")
    item_rows = windows(items.select(F.col("item"), "raw", "words", "maybe"), "item", "at", "want", words)
    item_rows = written(item_rows.where("item is not null"), "leaks-items")
    count = item_rows.count()
    sizes = item_rows.where("not named").groupBy("item").agg(F.count("*").alias("item_windows"))
    near = touched(docs, written(item_rows.select("hash").distinct(), "leaks-hashes"), key, text, words)
    near = sent(near).withColumnRenamed("doc", "_near")
    some = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(near, F.col("doc").eqNullSafe(F.col("_near")), "left_semi")
    texts = templates(some, "text").select("doc", "raw", "words", "maybe")
    doc_rows = windows(texts, "doc", "place", "have", words)
    item_side = item_rows.withColumnRenamed("named", "item_named")
    side = F.broadcast(item_side) if count <= SENT_WINDOWS else item_side
    found = written(
        doc_rows.join(side, "hash").select(
            "doc", "item", "at", "place", (F.col("place") - F.col("at")).alias("shift"), "want", "have", (F.col("named") | F.col("item_named")).alias("named")
        ),
        "leaks-hits",
    ).distinct()
    # Pairs that cannot meet a condition in any way.
    enough = (
        found.groupBy("doc", "item").agg(F.count_distinct("at").alias("n")).join(sizes, "item")
        .where((F.col("n") >= covered * F.col("item_windows")) | (F.col("n") + words - 1 >= longest)).select("doc", "item")
    )

    # Ways to count a hit: all its windows (2), without second hashes (4), without changed slots (3);
    # at its shift (+ 0), or in two spans of shifts (- 4) such that neighbours share one.
    span = F.floor(F.col("shift") / NEARBY)

    def ways(rank: int, fits: Column) -> Column:
        def way(k: int, group: Column) -> Column:
            return F.struct(F.lit(k).alias("rank"), group.cast("long").alias("group"))

        some = F.array(way(rank, F.col("shift")), way(rank - 4, span), way(rank - 4, span + 1))
        return F.when(fits, some).otherwise(F.slice(some, 1, 0))

    each = [ways(4, ~F.col("named")), ways(2, F.lit(True))]
    if verbatim:
        each.append(ways(3, ~F.col("named") & F.coalesce(F.col("want") == F.col("have"), F.lit(True))))
    hits = written(
        found.join(enough, ["doc", "item"], "left_semi").withColumn("way", F.explode(F.concat(*each))), "leaks-ways"
    )
    of = ["doc", "item", "way"]

    # Runs of windows side by side at one shift.
    order = Window.partitionBy(*of, "shift").orderBy("at")
    runs = (
        hits.select(*of, "shift", "at").distinct()
        .withColumn("run", F.col("at") - F.row_number().over(order))
        .groupBy(*of, "shift", "run")
        .agg(F.count("*").alias("n"))
        .groupBy(*of)
        .agg((F.max("n") + words - 1).alias("longest_words"), F.min("shift").alias("shift"))
        .join(hits.groupBy(*of).agg(F.count_distinct("at").alias("n_windows")), of)
        .join(sizes, "item")
        .where((F.col("n_windows") >= covered * F.col("item_windows")) | (F.col("longest_words") >= longest))
    )
    # One row for each slot: the item's value and the document's.
    pairs = (
        hits.where("want is not null")
        .select(*of, "shift", "at", F.posexplode(F.arrays_zip("want", "have")))
        .where("col.want <> ''")
        .select(*of, "shift", (F.col("at") + F.col("pos")).alias("slot"), "col.want", "col.have")
        .distinct()
    )
    by_want = pairs.groupBy(*of, "want").agg(
        F.count("*").alias("n"), F.min("have").alias("low"), F.max("have").alias("high")
    )
    by_have = pairs.groupBy(*of, "have").agg(F.min("want").alias("low"), F.max("want").alias("high"))
    slots = (
        by_want.groupBy(*of)
        .agg(
            F.sum("n").alias("n_slots"),
            F.bool_and(F.col("low") == F.col("high")).alias("forth"),
            F.bool_and((F.col("low") == F.col("want")) & (F.col("high") == F.col("want"))).alias("same"),
        )
        .join(by_have.groupBy(*of).agg(F.bool_and(F.col("low") == F.col("high")).alias("back")), of)
    )
    judged = runs.join(slots, of, "left").where("n_slots is null or (forth and back)")
    best = judged.groupBy("doc", "item").agg(
        F.max(
            F.struct(
                "n_windows", "longest_words", "way.rank", (-F.col("shift")).alias("minus"), "item_windows",
                F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("same", F.lit(True)).alias("exact"),
            )
        ).alias("b")
    )
    return best.select(
        F.col("doc").alias(key), F.col("item").alias(item), "b.n_windows", "b.item_windows", "b.longest_words", "b.n_slots", "b.exact"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """docs without those that hold a leaked item. Every row is judged by itself: where the key is
    null or repeats, rows are numbered first."""
    columns = docs.columns
    if not has_plain_key(docs, key):
        key = free_name(docs, "row")
        docs = written(docs.withColumn(key, F.monotonically_increasing_id()), "leaks-rows")
    gone = free_name(docs, "gone")
    dirty = leaks(docs, benchmark, key, **options).select(F.col(key).alias(gone)).distinct()
    return docs.join(sent(written(dirty, "leaks-dirty")), F.col(key) == F.col(gone), "left_anti").select(*columns)
