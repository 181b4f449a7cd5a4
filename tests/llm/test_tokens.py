"""BPE and token counts against the libraries they follow."""

import random
import struct

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from runsift.llm import bpe, token_counts
from runsift.llm.common import tokenizer_path

ODD = [None, "", " ", "\n\n", "a", "  two  spaces ", "<|endoftext|>x<|startoftext|>", "É́ ΣΑΣ İ", "漢字😀 ▁x", "w" * 3000, "a b " * 5000]


def random_texts(n, letters, seed):
    dice = random.Random(seed)
    return ["".join(dice.choice(letters) for _ in range(dice.randint(0, 60))) for _ in range(n)]


def test_bpe_is_the_librarys(documents):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = ODD + random_texts(400, [*"abcde  \n.,'é19ß漢😀_-AB\t\x1c\x85", "'ll", "<|endoftext|>", "the "], 3)
    rows = {r.doc_id: r for r in bpe.encode_decode(documents(texts)).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[k].ids == ids and rows[k].n_tokens == len(ids)
        assert rows[k].decoded == library.decode(ids, skip_special_tokens=False)
        assert (rows[k].text, rows[k].score) == (text, "x")


def test_bpe_merges_long_words_and_ties():
    encoder = bpe.WordBpe(tokenizer_path("word_bpe_49k.json"))
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for word in ("ababababab" * 300, "aaaaaaaaaaaaaaa", "x"):
        ids = encoder.encode(word)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(word).ids


def test_bpe_rejects_another_kind_of_file():
    with pytest.raises(ValueError):
        bpe.WordBpe(tokenizer_path("byte_bpe_50k.json"))


def test_prefix_counts_are_the_librarys(documents):
    library = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = ODD[:9] + random_texts(150, "abcde  \n.,'é1290ß漢😀()_=-ΣAB<s>\t▁²)", 4)
    rows = {r.doc_id: r for r in token_counts.token_counts(documents(texts), budget=7, prefixes=True).collect()}
    for k, text in enumerate(texts):
        text = text or ""
        expected = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert rows[k].prefix_counts == expected and rows[k].n_tokens == expected[-1]
        assert rows[k].cut_chars == max(i for i, n in enumerate(expected) if n <= 7)
        assert rows[k].n_bytes == len(text.encode())


def test_long_texts_are_counted_whole(documents):
    library = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = ODD[9:] + ["=" * 4000, " " * 300 + "x"]
    rows = token_counts.token_counts(documents(texts)).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(library.encode(t)) for k, t in enumerate(texts)}


def test_tables_are_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 3)
    monkeypatch.setattr(token_counts, "KEPT_TOTALS", 3)
    monkeypatch.setattr(bpe, "KEPT", 3)
    library = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    words = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    counter, encoder = token_counts.PrefixCounter(tokenizer_path("piece_bpe_32k.model")), bpe.WordBpe(tokenizer_path("word_bpe_49k.json"))
    for text in random_texts(60, "abc de,f. ", 5):
        assert counter.total(text) == len(library.encode(text))
        assert len(encoder.encode(text)) == 4 * len(words.encode(text, add_special_tokens=False).ids)
    assert len(counter.tables) <= 3 and len(counter.totals) <= 3 and len(encoder.words) <= 3


def test_empty_tables(documents, spark):
    empty = documents([])
    assert bpe.encode_decode(empty).count() == 0
    assert token_counts.token_counts(empty).count() == 0
