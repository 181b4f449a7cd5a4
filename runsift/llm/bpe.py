"""BPE encoding with a priority queue of merge ranks over a doubly linked symbol list, and decoding.

A word starts as a list of symbols linked to both neighbours. Every adjacent pair that has a merge
rank stands in a heap as rank and position; the lowest rank merges first, the leftmost on ties.
An entry whose pair has changed since it was pushed is stale: its pair no longer has the rank of
the entry, and it is skipped. Decoding puts the vocabulary strings together with the separator of
the vocabulary's decoder.

Built for vocabulary files of the word kind (merges over byte symbols, word-end suffix). Words
repeat, so ids of frequent words are kept, in two generations of bounded size: when the younger
one is full it becomes the older one, and words that occur again move over. Null texts count as empty; an empty
text has no ids and decodes to an empty text. Texts are encoded whole, whatever their length; equal
rows give equal results. Strings of special tokens inside a text become special tokens, as the
library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from runsift.llm.common import beside_text, tokenizer_path

#: Bytes of words and ids, with what Python adds, in one generation of a worker.
KEPT = 24 << 20
#: Bits for a position inside a word in a heap entry; longer words use plain pairs of numbers.
POSITIONS = 1 << 24
#: Texts that are encoded at a time: with ids and decoded forms they are several times as large.
STEP = 64
#: Characters outside of ASCII and the letters of Latin-1, whose classes and case need no tables.
BEYOND_LATIN = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")
#: The words of the files of this kind, and the same for Latin letters in lower case.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xe0-\xf6\xf8-\xff\xdf]+|[0-9]|[^\\sa-z0-9\xe0-\xf6\xf8-\xff\xdf]+", re.ASCII)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin characters for themselves, the others from code point 256 on in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Words(dict):
    """Text -> what `encode` makes of it, filled on demand; two generations of `most` bytes."""

    def __init__(self, encode, most: int) -> None:
        self.encode, self.most, self.size = encode, most, 0
        self.older: dict = {}

    def __missing__(self, word: str):
        found = self.older.get(word)
        if found is None:
            found = self.encode(word)
        # Two objects and their place in the table.
        self.size += 200 + len(word) + len(found)
        if self.size > self.most:
            self.older, self.size = dict(self), 0
            self.clear()
        self[word] = found
        return found


class WordBpe:
    """Encoder and decoder for one vocabulary file of the word kind."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split, level = (spec["pre_tokenizer"] or {}).get("pretokenizers") or ({}, {})
        steps = [step["type"] for step in (spec["normalizer"] or {}).get("normalizers", ())]
        known = (
            steps == ["NFC", "Replace", "Lowercase"]
            and (split["behavior"], split["invert"]) == ("Removed", True)
            and (level["type"], level["add_prefix_space"], level["use_regex"]) == ("ByteLevel", False, False)
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and spec["decoder"] is None
            and split["pattern"] == {"Regex": WORDS}
        )
        if not known:
            raise ValueError(f"{path} is not of the word kind")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        found = self.vocab | self.special
        self.text: list[str | None] = [None] * (max(found.values(), default=-1) + 1)
        for t, i in found.items():
            self.text[i] = t
        #: (left id << 32 | right id) -> (rank, merged id)
        self.merges = {
            self.vocab[a] << 32 | self.vocab[b]: (rank, self.vocab[a + b])
            for rank, (a, b) in enumerate(model["merges"])
        }
        symbols = byte_symbols()
        #: The id of each byte inside a word, and as its last one; None if there is none.
        self.inner = [self.vocab.get(c) for c in symbols]
        self.final = [self.vocab.get(c + self.suffix) for c in symbols]
        self.finder = regex.compile(WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Words(self._encode_word, KEPT)

    def merge(self, symbols: list[int]) -> list[int]:
        """What is left of a list of symbols when no pair can merge any more."""
        n, find = len(symbols), self.merges.get
        queue = []
        for k in range(n - 1):
            found = find(symbols[k] << 32 | symbols[k + 1])
            if found:
                queue.append((found[0] * POSITIONS + k) if n < POSITIONS else (found[0], k))
        if not queue:
            return symbols
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = pop(queue)
            rank, k = divmod(entry, POSITIONS) if n < POSITIONS else entry
            right = after[k]
            # A symbol that has gone into its left neighbour is None.
            if right >= n or symbols[k] is None:
                continue
            found = find(symbols[k] << 32 | symbols[right])
            if not found or found[0] != rank:
                continue
            merged = symbols[k] = found[1]
            symbols[right] = None
            follow = after[k] = after[right]
            if follow < n:
                before[follow] = k
                found = find(merged << 32 | symbols[follow])
                if found:
                    push(queue, (found[0] * POSITIONS + k) if n < POSITIONS else (found[0], k))
            left = before[k]
            if left >= 0:
                found = find(symbols[left] << 32 | merged)
                if found:
                    push(queue, (found[0] * POSITIONS + left) if n < POSITIONS else (found[0], left))
        return [s for s in symbols if s is not None]

    def _encode_word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        symbols = [inner[b] for b in raw[:-1]]
        symbols.append(self.final[raw[-1]])
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        return array("I", self.merge(symbols)).tobytes()

    def _words(self, text: str) -> list[str]:
        # White space needs no replacing: it only ends words. Lower case goes by characters,
        # without the rule for a sigma at the end of a word.
        if BEYOND_LATIN.search(text):
            return self.finder.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return LATIN_WORDS.findall(text.lower())

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get = self.words.__getitem__
        if self.specials is None or "<" not in text or not self.specials.search(text):
            return b"".join(map(get, self._words(text)))
        out = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                out += map(get, self._words(part))
        return b"".join(out)

    def decode(self, ids: Sequence[int]) -> str:
        """The vocabulary strings of the ids, one space between them (the file has no decoder);
        ids outside of the vocabulary are left out."""
        text, n = self.text, len(self.text)
        return " ".join([text[i] for i in ids if 0 <= i < n and text[i] is not None])

    def decode_own(self, ids: bytes) -> str:
        """decode of what encode gave."""
        return " ".join(map(self.text.__getitem__, array("I", ids)))


_ENCODERS: dict[str, WordBpe] = {}


def encoder(model: str) -> WordBpe:
    """One encoder for each worker process and file."""
    path = tokenizer_path(model)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


def encode_decode(
    docs: DataFrame,
    model: str = "word_bpe_49k.json",
    text: str = "text",
    digests: bool = False,
) -> DataFrame:
    """All columns of docs and n_tokens, ids (array of integers) and decoded; with `digests`,
    instead of the last two, ids_sha256 and decoded_sha256. Columns of docs with these names give
    way to the new ones."""
    import pyarrow as pa

    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    kept = [c for c in docs.columns if c not in new]
    schema = docs.select(*kept).schema.add("n_tokens", T.LongType())
    if digests:
        schema = schema.add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())
    else:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model)
        sha = hashlib.sha256
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                made_ids = list(map(bpe.encode, [t or "" for t in part.column(place).to_pylist()]))
                texts = map(bpe.decode_own, made_ids)
                counts = [len(ids) // 4 for ids in made_ids]
                if digests:
                    made = [
                        pa.array([sha(ids).hexdigest() for ids in made_ids], pa.string()),
                        pa.array([sha(t.encode("utf-8")).hexdigest() for t in texts], pa.string()),
                    ]
                else:
                    flat = pa.array(np.frombuffer(b"".join(made_ids), np.int32))
                    ends = pa.array(np.cumsum([0, *counts]), pa.int32())
                    made = [pa.ListArray.from_arrays(ends, flat), pa.array(list(texts), pa.string())]
                columns = [*part.columns[: len(kept)], pa.array(counts, pa.int64()), *made]
                yield pa.RecordBatch.from_arrays(columns, names=kept + new)

    rows, place = beside_text(docs, kept, text)
    return rows.mapInArrow(run, schema)
