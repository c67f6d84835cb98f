"""Language identification by cross-parsing: how few phrases of a language's text does a document need?"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .texts import bound_batches, give_back, remembered

UNDETERMINED = "und"
TRAIN_SYMBOLS = 40_000  # symbols of labelled text learned per language
TRAIN_ROWS = 100  # labelled rows sampled per language
TRAIN_CHARS = 8_000  # rows longer than this are sampled only where shorter ones are lacking
BLOCK = 4_096  # symbols parsed in one go; a phrase does not reach over the end of a block
LANES = 4_096  # blocks parsed side by side
WIDE_LANES = 1_024  # the same where symbols take four bytes
SLICE_CHARS = 4 * 1024 * 1024  # characters of texts classified in one go

_SEPARATOR, _UNKNOWN = 1, 0  # symbol of a run of non-letters, symbol of a letter no language was learned with
_STEP = 28  # a transition holds the target in its low bits and the phrases it closes above


@dataclass(frozen=True)
class LanguageModel:
    """Learned symbols and, per language, its training text in these symbols (``symbol_type`` of the letters)."""

    letters: str
    texts: tuple[tuple[str, bytes], ...]


def symbol_type(letters: str) -> np.dtype:
    """One byte a symbol while all letters fit, four for larger scripts: no learned letter is left out."""
    return np.dtype(np.uint8 if len(letters) + 2 <= 256 else np.uint32)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    documents: DataFrame, train_rows: int = TRAIN_ROWS, train_symbols: int = TRAIN_SYMBOLS, train_chars: int = TRAIN_CHARS
) -> LanguageModel:
    """Learn every non-null lang of the rows outside the held-out fifth.

    The sample is bounded: per language the ``train_rows`` first rows by hash of doc_id (long texts last), of which
    ``train_symbols`` symbols are learned.  The driver receives no more than that many rows of that many characters.
    """
    usable = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.select("doc_id", "text", "lang")
    order = [F.char_length("text") > train_chars, F.xxhash64("doc_id"), F.col("doc_id")]
    narrow = usable.select("doc_id", "lang", F.struct(*order).alias("place"))
    ranked = narrow.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place")))
    sample = ranked.where(F.col("n") <= train_rows).select("doc_id", "lang", "n")
    cut = F.substring("text", 1, train_symbols).alias("text")
    rows = usable.join(F.broadcast(sample), ["doc_id", "lang"]).select("lang", "n", cut).orderBy("lang", "n", "text").collect()
    by_language: dict[str, list[str]] = {}
    for row in rows:
        by_language.setdefault(row["lang"], []).append(row["text"].lower())
    letters = "".join(sorted({c for texts in by_language.values() for t in texts for c in t if c.isalpha()}))
    table = symbol_table(letters)
    learned = []
    for lang, texts in sorted(by_language.items()):
        codes = symbols("\n".join(texts), table)[:train_symbols]
        if (codes != _SEPARATOR).any():
            learned.append((lang, codes.tobytes()))
    return LanguageModel(letters, tuple(learned))


def symbol_table(letters: str) -> np.ndarray:
    """Symbol of every code point: learned letters from 2 up, other letters unknown, all else a separator."""
    table = np.full(0x110000, _SEPARATOR, symbol_type(letters))
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = _UNKNOWN
    for i, letter in enumerate(letters):
        table[ord(letter)] = i + 2
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a whole text, lower-cased, runs of separators as one."""
    codes = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = codes == _SEPARATOR
    return codes[~(gap & np.concatenate(([False], gap[:-1])))]


def suffix_automaton(codes: Sequence[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``codes``; state 0 reads nothing yet."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = state
            at = link[at]
        if at >= 0:
            target = moves[at][c]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(c) == target:
                    moves[at][c] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    return moves


def _moves(codes: Sequence[int]) -> list[dict[int, int]]:
    """The automaton's transitions without those of the unknown symbol, which stands for many letters and equals none."""
    moves = suffix_automaton(codes)
    for row in moves:
        row.pop(_UNKNOWN, None)
    return moves


def transitions(codes: Sequence[int], n_symbols: int) -> np.ndarray:
    """The automaton with phrase ends built in: entry [state, symbol] is (phrases closed << 28) + next state * n_symbols.

    A symbol that does not extend the phrase closes it and starts the next one; a symbol the language never shows is a
    phrase of its own.
    """
    moves = _moves(codes)
    start = np.full(n_symbols, 1 << _STEP, np.int32)  # at the root an unseen symbol is a phrase of its own
    for c, target in moves[0].items():
        start[c] = target * n_symbols
    table = np.tile(start + (1 << _STEP), (len(moves), 1)).astype(np.int32)
    table[0] = start
    for state, row in enumerate(moves):
        for c, target in row.items():
            table[state, c] = target * n_symbols
    return table.ravel()


class SparseTransitions:
    """The same automaton for scripts of any size: a hash table of (state, symbol) with only the transitions there are."""

    def __init__(self, codes: Sequence[int], n_symbols: int):
        moves = _moves(codes)
        self.n = n_symbols
        self.root = np.full(n_symbols, -1, np.int32)
        for c, target in moves[0].items():
            self.root[c] = target
        pairs = [(state * n_symbols + c, target) for state, row in enumerate(moves) for c, target in row.items()]
        keys, targets = np.array(pairs, np.int64).reshape(-1, 2).T
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.targets = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots[left]] == keys[left]
            self.targets[slots[left[placed]]] = targets[left[placed]]
            left = left[~placed]
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and the phrases each step closes."""
        keys = state.astype(np.int64) * self.n + symbol
        slots = self._slots(keys)
        held = self.keys[slots]
        target = np.where(held == keys, self.targets[slots], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
            held = self.keys[slots[left]]
            hit = held == keys[left]
            target[left[hit]] = self.targets[slots[left[hit]]]
            left = left[~hit & (held >= 0)]
        missed = np.flatnonzero(target < 0)
        root, closed = self.root[symbol[missed]], np.zeros(len(state), np.int32)
        closed[missed] = (state[missed] > 0).astype(np.int32) + (root < 0)
        target[missed] = np.maximum(root, 0)
        return target, closed


def _prepare(model: LanguageModel) -> tuple[np.ndarray, list[np.ndarray | SparseTransitions]]:
    prepared = remembered("language")
    if model not in prepared:
        prepared.clear()
        n, kind = len(model.letters) + 2, symbol_type(model.letters)
        build = transitions if kind.itemsize == 1 else SparseTransitions
        automata = []
        for _, codes in model.texts:
            automata.append(build(np.frombuffer(codes, kind).tolist(), n))
            give_back()  # an automaton is built from as many dictionaries as it has states
        prepared[model] = symbol_table(model.letters), automata
    return prepared[model]


def count_phrases(blocks: list[np.ndarray], table: np.ndarray | SparseTransitions) -> np.ndarray:
    """Phrases of every block; ``blocks`` run from long to short and are parsed side by side, one symbol at a time."""
    lengths = np.array([len(b) for b in blocks])
    steps = int(lengths[0])
    matrix = np.zeros((steps, len(blocks)), blocks[0].dtype)
    for i, block in enumerate(blocks):
        matrix[: len(block), i] = block
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # blocks longer than the step
    state, phrases, mask = np.zeros(len(blocks), np.int32), np.zeros(len(blocks), np.int32), (1 << _STEP) - 1
    for step in range(steps):
        k = active[step]
        if isinstance(table, SparseTransitions):
            state[:k], closed = table.step(state[:k], matrix[step, :k])
            phrases[:k] += closed
            continue
        moved = table[state[:k] + matrix[step, :k]]
        phrases[:k] += moved >> _STEP
        state[:k] = moved & mask
    return phrases + (state > 0)


def classify(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    table, automata = _prepare(model)
    owners, blocks, sizes, seen = [], [], np.zeros(len(texts)), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        codes = symbols(text, table) if text else np.empty(0, table.dtype)
        if len(codes) == 0 or not (codes != _SEPARATOR).any():
            continue
        seen[i], sizes[i] = True, len(codes)
        for at in range(0, len(codes), BLOCK):
            owners.append(i)
            blocks.append(codes[at : at + BLOCK])
    names = [lang for lang, _ in model.texts]
    if not names or not blocks:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    order = sorted(range(len(blocks)), key=lambda j: -len(blocks[j]))
    rates = np.zeros((len(names), len(texts)))
    lanes = LANES if table.dtype.itemsize == 1 else WIDE_LANES
    for at in range(0, len(order), lanes):
        lane = order[at : at + lanes]
        group, owner = [blocks[j] for j in lane], [owners[j] for j in lane]
        for k, automaton in enumerate(automata):
            np.add.at(rates[k], owner, count_phrases(group, automaton))
    for k, (_, codes) in enumerate(model.texts):  # phrases a symbol, weighed by the bits that point into the training text
        rates[k] *= math.log2(len(codes) // table.dtype.itemsize + 1) / np.maximum(sizes, 1)
    best = rates.argmin(axis=0)  # equal rates: the first name
    lowest = rates.min(axis=0)
    others = np.where(np.arange(len(names))[:, None] == best, np.inf, rates).min(axis=0)
    score = np.where(seen, np.clip(1 - lowest / others, 0, 1), 0.0)
    return [names[b] if s else UNDETERMINED for b, s in zip(best, seen)], score


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """All texts in order, in slices of ``SLICE_CHARS`` characters or one text."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= SLICE_CHARS:
            yield texts[start : i + 1]
            start, chars = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def with_language(documents: DataFrame, model: LanguageModel, text: str = "text", name: str = "__language") -> DataFrame:
    """``documents`` with a struct column ``name`` of lang_pred and score, from the whole text alone.

    lang_pred is a learned language; ``und`` with score 0 where text is null or has no letter, or nothing was learned.
    score is 1 - (rate of the best language / rate of the second): 0 for a tie (the smaller name wins), 1 where only one
    language was learned.  Other columns pass through; an empty table stays empty; repeated rows get equal answers.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            names, scores = [], [np.empty(0)]
            for some in _slices([t if isinstance(t, str) else None for t in part]):
                told, score = classify(some, model)
                names += told
                scores.append(score)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores)})
            give_back()

    bound_batches(documents)
    return documents.withColumn(name, predict(F.col(text)))


def identify(documents: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from the documents' own labels by default."""
    rows = with_language(documents.select("doc_id", "text"), model or fit(documents))
    return rows.select("doc_id", held_out().alias("held_out"), "__language.lang_pred", "__language.score")
