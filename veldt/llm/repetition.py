"""Rules for texts that repeat themselves: characters inside duplicated word n-grams and lines.

A batch's words are numbered, and lie as one row of numbers. Rolling hashes of windows of several
lengths come from one prefix sum; the characters of the words in windows whose hash has occurred
before in the text are its measure. A window can only occur twice where a shorter one does, so each
length looks at the places that the length before it left. Windows of three words,
which a hard rule counts, are compared by their words' numbers and not by a hash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm.bytebpe import batches_of
from veldt.llm.common import fresh, in_tasks

EXACT = 3  # words of the windows of the hard rule
LENGTHS = (5, 6, 7, 8, 9, 10)  # words of the windows whose characters are measured
#: The share of a text's word characters, in percent, that windows of each length which repeat an earlier one may cover.
ALLOWED = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_SHARE = 50  # percent of the lines with a word that may repeat an earlier one
LINE_CHARS = 20  # percent of the word characters that may be in such lines
SYMBOLS = b"#*$%&|<>"
SYMBOL_SHARE = 10  # symbols to 100 words
LEAST_WORDS = 50
REPEATED_WORDS = 50  # percent of the words that may be in windows of three that occur twice
_ODD = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well spread bits for each whole number."""
    x = x.astype(np.uint64) + _ODD  # wraps, as do the products
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more, and whether it has occurred before."""
    order = np.argsort(key, kind="stable")
    own = key[order]
    same = np.append(False, own[1:] == own[:-1])[: len(key)]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order] = same
    twice[order] = same | np.append(same[1:], False)[: len(key)]
    return twice, later


def _covered(start: np.ndarray, n: int, words: int) -> np.ndarray:
    """Whether each word lies in a window of ``n`` words that begins at one of ``start``."""
    step = np.zeros(words + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + n, -1)
    return np.cumsum(step[:-1]) > 0


class _Hashes:
    """Rolling hashes of windows of any length over one row of word numbers."""

    def __init__(self, word: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(word), _ODD, np.uint64)))
            self.sums = np.append(np.uint64(0), np.cumsum(_mixed(word) * power[:-1], dtype=np.uint64))
            back = np.uint64(pow(int(_ODD), -1, 1 << 64))
            self.undo = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(word), back, np.uint64)))

    def at(self, start: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + n] - self.sums[start]) * self.undo[start]


def _exact_windows(word: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows of three words occur twice in their text, by the words themselves."""
    key = text[start]
    for i in range(EXACT):
        key = key * (int(word.max(initial=0)) + 1) + word[start + i]
        key = np.unique(key, return_inverse=True)[1]
    return np.bincount(key, minlength=1)[key] > 1 if len(key) else np.zeros(0, bool)


def measure(texts: list[bytes], lengths: tuple[int, ...] = LENGTHS) -> dict[str, np.ndarray]:
    """The counts of each text, and ``repeat_chars_<n>`` for each length."""
    number = defaultdict(count().__next__)
    cut = [x.split() for x in texts]
    size = np.array([len(x) for x in cut], np.int64)
    word = np.fromiter((number[w] for x in cut for w in x), np.int64, int(size.sum()))
    chars = np.array([len(w.decode()) for w in number] or [0], np.int64)[word] if len(word) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), size)
    end = np.repeat(np.cumsum(size), size)  # of each word's text
    per_text = lambda x: np.bincount(text, x, len(texts)).astype(np.int64)
    out = {"n_words": size, "word_chars": per_text(chars)}
    out["n_symbols"] = np.array([len(x) - len(x.translate(None, SYMBOLS)) for x in texts], np.int64)
    lines = [_lines(x) for x in texts]
    for i, name in enumerate(("n_lines", "n_dup_lines", "dup_line_chars")):
        out[name] = np.array([x[i] for x in lines], np.int64)
    place = np.arange(len(word))
    start = place[place + EXACT <= end]
    start = start[_exact_windows(word, text, start)]
    out["n_repeat_words"] = per_text(_covered(start, EXACT, len(word)))
    hashes = _Hashes(word)
    for n in lengths:
        start = start[start + n <= end[start]]
        with np.errstate(over="ignore"):
            twice, later = _repeated(hashes.at(start, n) ^ _mixed(text[start]))
        out[f"repeat_chars_{n}"] = per_text(np.where(_covered(start[later], n, len(word)), chars, 0))
        start = start[twice]
    return out


def _lines(raw: bytes) -> tuple[int, int, int]:
    """(lines with a word, those of them equal to an earlier one, the word characters of these)."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    own = set(lines)
    if len(own) == len(lines):
        return len(lines), 0, 0
    seen, chars = set(), 0
    for x in lines:
        if x in seen:
            chars += sum(len(w.decode()) for w in x.split())
        seen.add(x)
    return len(lines), len(lines) - len(own), chars


def count_repetition(docs: DataFrame, text_col: str = "text", name: str = "repetition") -> DataFrame:
    """``docs`` with a struct column of whole numbers: words, word characters, symbols, lines with a
    word, lines equal to an earlier one and their word characters, words in windows of three that occur
    twice, and the word characters in windows of each length that repeat an earlier one.

    Null and empty texts have zeros. Texts go whole, however long; repeated rows and null ids stay;
    other columns stay as they are, whatever their names, one named ``name`` is replaced. An empty
    table gives an empty one.
    """
    kept = docs.drop(name)
    at = kept.columns.index(text_col)
    fields = [*_COUNTS, *(f"repeat_chars_{n}" for n in LENGTHS)]
    kind = T.StructType([T.StructField(x, T.LongType(), False) for x in fields])
    schema = T.StructType([*kept.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            for s, e in batches_of(texts):
                found = measure([x.encode() for x in texts[s:e]])
                mark = pa.StructArray.from_arrays([pa.array(found[x]) for x in fields], fields=[pa.field(x, pa.int64(), False) for x in fields])
                yield pa.RecordBatch.from_arrays([*batch.slice(s, e - s).columns, mark], schema.fieldNames())

    return kept.transform(in_tasks, run, schema)


def base_failed(name: str = "repetition") -> Column:
    """Too few words, or too many of them in windows of three that occur twice."""
    mark = F.col(name)
    return (mark["n_words"] < LEAST_WORDS) | (100 * mark["n_repeat_words"] > REPEATED_WORDS * mark["n_words"])


def is_kept(name: str = "repetition") -> Column:
    """No rule fails: neither the hard ones nor a limit on duplicated lines, n-grams or symbols.

    All limits compare whole numbers, and a text right at a limit is kept.
    """
    mark = F.col(name)
    failed = base_failed(name) | (100 * mark["n_symbols"] > SYMBOL_SHARE * mark["n_words"])
    failed |= (100 * mark["n_dup_lines"] > LINE_SHARE * mark["n_lines"]) | (100 * mark["dup_line_chars"] > LINE_CHARS * mark["word_chars"])
    for n, share in ALLOWED.items():
        failed |= 100 * mark[f"repeat_chars_{n}"] > share * mark["word_chars"]
    return ~failed


def keep_varied(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects; no column is changed."""
    (name,) = fresh(docs, "repetition")
    return count_repetition(docs, text_col, name).where(is_kept(name)).drop(name)
