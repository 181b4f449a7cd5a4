"""Token counts at every prefix of a text, by dynamic programming over prefixes.

For a BPE vocabulary in which a merge is ranked by the piece that it makes, the encoding of a
prefix of i characters is the encoding of the prefix without its last token, plus that token. The
last token is the only piece that ends at i and that does not merge across the border to the last
token before it. So count[i] = count[i - len(piece)] + 1, for all prefixes in one pass, and
truncation or budget questions are lookups: no text is encoded again.

Pieces never cross certain borders (a space after a letter, a letter after a digit); the borders
are learned from the vocabulary. The table of a stretch between two such borders does not depend
on the rest of the text, so tables of frequent stretches are kept. The memory for them is bounded.

Null texts count as empty; an empty text has 0 tokens. Equal rows give equal results. Texts of any
length are taken whole. All other columns are left out of the result, but for `key`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import slices, tokenizer_path, whole_text

SPACE = "▁"
#: Stretches whose tables, and words whose totals, one Python worker keeps.
KEPT, KEPT_TOTALS = 400_000, 1_000_000
#: Characters of the longest stretch that is kept.
LONGEST_KEPT = 64
LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]")


def _kind(c: str) -> int:
    """0 space mark, 1 Latin letter, 2 other."""
    return 0 if c == SPACE else 1 if LETTER.match(c) else 2


class Totals(dict):
    """Word without its space -> tokens with it; filled on demand and emptied when it is full."""

    def __init__(self, count) -> None:
        self.count = count

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_TOTALS:
            self.clear()
        found = self.count(word)
        if len(word) < LONGEST_KEPT:
            self[word] = found
        return found


class PrefixCounter:
    """Exact token counts of all prefixes for one vocabulary file of the piece kind."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = [
            (model.id_to_piece(i), model.get_score(i), i)
            for i in range(model.vocab_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        #: piece -> (rank, id); a lower rank merges first.
        self.pieces = {p: (-score, i) for p, score, i in pieces}
        self.text = {i: p for p, _, i in pieces}
        #: Last two characters -> lengths of the pieces that end in them, the longest first.
        sizes: dict[str, set[int]] = {}
        for piece in self.pieces:
            if len(piece) > 1:
                sizes.setdefault(piece[-2:], set()).add(len(piece))
        self.sizes = {end: (*sorted(found, reverse=True), 1) for end, found in sizes.items()}
        self.joins = {(_kind(a), _kind(b)) for p in self.pieces for a, b in zip(p, p[1:])}
        #: piece -> piece behind it -> whether both stand as they are.
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        #: stretch -> (counts, last tokens) of all its prefixes.
        self.tables: dict[str, tuple[Sequence[int], tuple[str, ...]]] = {}
        self.totals = Totals(self._marked_total)
        self.splits = (1, 0) not in self.joins and (2, 0) not in self.joins
        self.stretch = self._stretches()

    def _stretches(self):
        """A pattern whose matches are stretches that no piece leaves."""
        letters, marks = LETTER.pattern, "\\u2581"
        other = f"(?:(?!{letters})[^{marks}])"
        if any((a, b) in self.joins for a, b in ((1, 2), (2, 1), (1, 0), (2, 0))):
            # Mixed pieces: only a space after something else is a border, if even that.
            return re.compile(f"(?s){marks}*[^{marks}]+|{marks}+" if self.splits else "(?s).+")
        return re.compile(f"{marks}*(?:{letters}+|{other}+)|{marks}+")

    # -- merging two pieces ------------------------------------------------------------------
    def _merged(self, text: str) -> list[str]:
        """The pieces of a short text by plain merging: the lowest rank first, leftmost on ties."""
        parts, pieces = list(text), self.pieces
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = pieces.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or found[0] < best):
                    best, at = found[0], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stand(self, left: str, right: str) -> bool:
        """Whether the two pieces side by side are what merging their text gives."""
        return self._merged(left + right) == [left, right]

    # -- prefix tables -----------------------------------------------------------------------
    def table(self, stretch: str) -> Sequence[int]:
        """counts[i]: tokens of the first i + 1 characters of a stretch (spaces as marks)."""
        found = self.tables.get(stretch)
        if found is not None:
            return found[0]
        n, pieces, pairs, sizes, single = len(stretch), self.pieces, self.pairs, self.sizes, (1,)
        count, last = [0], [""]
        # The table of a stretch that this one begins with is its first part.
        for known in range(n - 1, 2, -1):
            found = self.tables.get(stretch[:known])
            if found is not None:
                count, last = [0, *found[0]], ["", *found[1]]
                break
        for i in range(len(count), n + 1):
            for size in sizes.get(stretch[i - 2 : i], single) if i > 1 else single:
                if size > i:
                    continue
                piece = stretch[i - size : i]
                if piece not in pieces:
                    continue
                before = last[i - size]
                follows = pairs.get(before)
                if follows is None:
                    follows = pairs[before] = {}
                fits = follows.get(piece)
                if fits is None:
                    fits = self._stand(before, piece) if before else self._merged(piece) == [piece]
                    follows[piece] = fits
                    self.n_pairs += 1
                if fits:
                    count.append(count[i - size] + 1)
                    last.append(piece)
                    break
            else:
                # A character outside of the vocabulary: one token for each of its bytes. A lone
                # character that is a piece never comes here, for it stands before all it cannot
                # merge with.
                count.append(count[i - 1] + len(stretch[i - 1].encode("utf-8", "surrogatepass")))
                last.append(stretch[i - 1])
        if self.n_pairs > KEPT:
            pairs.clear()
            self.n_pairs = 0
        counts = bytes(count[1:]) if count[-1] < 256 and max(count) < 256 else tuple(count[1:])
        if n <= LONGEST_KEPT:
            if len(self.tables) >= KEPT:
                self.tables.clear()
            self.tables[stretch] = counts, tuple(last[1:])
        return counts

    def _normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _marked_total(self, text: str) -> int:
        table = self.table
        return sum(table(stretch)[-1] for stretch in self.stretch.findall(self._normal(text)))

    def total(self, text: str) -> int:
        """Words between single spaces are counted on their own where no piece goes on behind a
        word's last character; runs of spaces join the word behind them."""
        if not self.splits or "  " in text or text.startswith(" ") or text.endswith(" ") or SPACE in text:
            return self._marked_total(text)
        return sum(map(self.totals.__getitem__, text.split(" "))) if text else 0

    def prefixes(self, text: str) -> list[int]:
        """counts[i]: tokens of text[:i], for i from 0 to the length."""
        out, base = [], 0
        for stretch in self.stretch.findall(self._normal(text)):
            counts = self.table(stretch)
            out += [base + c for c in counts]
            base = out[-1]
        # out[0] is the mark that the library sets before a text; an empty text has none.
        return [0, *out[1:]] if out else [0]

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix whose count is within the budget."""
        base, at = 0, -1
        for stretch in self.stretch.findall(self._normal(text)):
            counts = self.table(stretch)
            if base + counts[-1] > budget:
                # Whatever lies behind this stretch counts more than the budget.
                within = [k for k, c in enumerate(counts, 1) if base + c <= budget]
                return max(at + (within[-1] if within else 0), 0)
            at += len(stretch)
            base += counts[-1]
        return max(at, 0)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    """One counter for each worker process and file."""
    path = tokenizer_path(model)
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(
    docs: DataFrame,
    model: str = "piece_bpe_32k.model",
    budget: int = 4096,
    key: str = "doc_id",
    text: str = "text",
    prefixes: bool = False,
) -> DataFrame:
    """key, n_bytes, n_tokens, cut_chars: the characters of the longest prefix within `budget`
    tokens; with `prefixes` also prefix_counts, the counts of all prefixes from none to the whole
    text."""
    import pyarrow as pa

    kind = dict(docs.dtypes)[key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = counter(model)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            totals = [tables.total(t) for t in texts]
            columns = [
                batch.column(0),
                pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                pa.array(totals, pa.int64()),
                pa.array([len(t) if n <= budget else tables.cut(t, budget) for t, n in zip(texts, totals)], pa.int64()),
            ]
            names = ["key", "n_bytes", "n_tokens", "cut_chars"]
            if prefixes:
                columns.append(pa.array([tables.prefixes(t) for t in texts], pa.list_(pa.int64())))
                names.append("prefix_counts")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"key {kind}, n_bytes bigint, n_tokens bigint, cut_chars bigint"
    return (
        docs.select(F.col(key), whole_text(text).alias("text"))
        .mapInArrow(count, schema + (", prefix_counts array<bigint>" if prefixes else ""))
        .withColumnRenamed("key", key)
    )
