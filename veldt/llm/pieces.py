"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

White space becomes U+2581 and one is put before the text. No piece of the vocabulary has that
mark after another character, so words, each with the marks before it, merge independently. A
worker encodes the words that it has not seen in one go: all their symbols lie in one flat array,
a round finds each word's best adjacent pair, merges it at once wherever it occurs in the word
from the left, and compacts the array; words without a pair drop out. A merge whose result could
take part in a better pair than itself is done one place at a time, so the outcome is that of one
best merge after another.

In long words a round merges every pair that is best among all pairs within a piece's length of it:
whatever could take one of its symbols away first lies inside one piece, and so within that reach.
Ranks are kept between rounds and looked up anew beside merges only. Texts in which such rounds make
little headway, as long runs of one character do, are finished pair by pair from a heap.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm.common import in_tasks

DEFAULT = "piece_bpe_32k.model"
MARK = "▁"
MEMO_BYTES = 96 << 20  # what a worker remembers, beside the words of one batch
ENTRY = 200  # bytes of a remembered word, beside its characters and ids
LONG = 96  # characters from which a word's pairs merge by reach
PASSES = 80  # times that the rounds by reach may go over a long word
ROUND_SYMBOLS = 400_000  # symbols that merge together
SLICE = 1 << 20  # bytes of the texts that are cut into words together
_NO_RANK = np.iinfo(np.int64).max
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


def _window_min(x: np.ndarray, reach: int) -> np.ndarray:
    """The least of each value and those up to ``reach`` places before and after it."""
    size, have = 2 * reach + 1, 1
    out = np.concatenate([np.full(reach, _NO_RANK), x, np.full(reach, _NO_RANK)])
    while have < size:  # ``out`` holds the least of ``have`` values from each place on
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class PieceBpe:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.control = {i for i in range(len(self.pieces)) if model.is_control(i)}
        self.bytes = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_ids = {v: k for k, v in self.bytes.items()}
        self.unk, self.end = model.unk_id(), model.eos_id()
        plain = [i for i in range(len(self.pieces)) if i not in self.control and i not in self.bytes and i != self.unk]
        self.ids = {self.pieces[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans words; this model needs whole-text merging")
        if len(self.byte_ids) != 256 or any(model.is_unused(i) for i in plain) or not self._plain_normaliser(model):
            raise ValueError("the model needs a normaliser, unused pieces or unknown ids that are not supported here")
        score = {i: model.get_score(i) for i in plain}
        order = sorted(set(score.values()), reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        # Symbols: the pieces' ids, and beyond them characters that are no piece.
        pairs = {}
        for i in plain:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                a, b = self._symbol(p[:cut]), self._symbol(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank_of[score[i]], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        best = np.full(len(self.pieces), _NO_RANK)
        for half in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            np.minimum.at(best, half, self.rank)
        own = np.full(len(self.pieces), _NO_RANK)
        own[self.made] = self.rank
        self.eager = best <= own  # as a part, it can make something that merges no later than itself
        if len(order) != len(plain):
            self.eager[:] = True
        self.reach = max(map(len, self.ids)) - 1
        self.pairs = pairs
        #: Ids of words, and the decoded text of those that don't decode to themselves. A word's key is what follows its mark, or the word if that would be empty or begin with a mark.
        self.memo: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}
        self.held = 0

    def _plain_normaliser(self, model) -> bool:
        odd = "  a  éé　ｆ\t\n "
        return model.decode(model.encode(odd)) == odd and model.encode("") == []

    def _symbol(self, text: str) -> int | None:
        return self.ids.get(text)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words in a row, how many each has) after all merges; a character that is no piece is -1 - its code point."""
        sizes = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        chars, back = np.unique(points, return_inverse=True)
        single = np.array([self.ids.get(chr(c), -1 - int(c)) for c in chars.tolist()], np.int64)
        flat, word = single[back], np.repeat(np.arange(len(words)), sizes)
        long = sizes[word] >= LONG
        parts = [self._rounds(flat[~long], word[~long]), self._rounds_by_reach(flat[long], word[long])]
        flat, word = (np.concatenate(x) for x in zip(*parts))
        return flat[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _merge(self, words: list[str]) -> list[np.ndarray]:
        """Symbols of each word after all merges."""
        flat, sizes = self.merged(words)
        return np.split(flat, np.cumsum(sizes)[:-1])

    def _looked_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, made piece) of each pair of neighbours."""
        key = np.where((a >= 0) & (b >= 0), a << 32 | np.maximum(b, 0), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NO_RANK), self.made[at]

    def _rounds_by_reach(self, flat: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, words) after all merges of long words.

        A pair merges if no other within reach is better, an equal one to the left included. Where
        what it makes can only merge later than itself, equal pairs do not wait for each other: of
        those that overlap every second one merges, counted from the left.
        """
        if len(flat) < 2:
            return flat, word
        rank, made = self._looked_up(flat[:-1], flat[1:])
        rank = np.where(word[1:] == word[:-1], rank, _NO_RANK)
        budget = PASSES * len(flat)
        while (able := rank < _NO_RANK).any():
            budget -= len(rank)
            if budget < 0:
                return self._one_by_one(flat, word, rank, made)
            place = np.arange(len(rank))
            key = np.where(able, np.minimum(rank, 1 << 30) << 32 | place, _NO_RANK)
            least = _window_min(key, self.reach)
            tied = able & (rank == least >> 32)
            start = np.maximum.accumulate(np.where(np.append(True, rank[1:] != rank[:-1]), place, 0))
            waiting = np.maximum.accumulate(np.where(tied, -1, place))
            take = able & (key == least) | tied & ((place - start) % 2 == 0) & (waiting < start) & ~self.eager[made]
            here = np.flatnonzero(take)
            flat[here] = made[here]
            keep = np.ones(len(flat), bool)
            keep[here + 1] = False
            flat, word = flat[keep], word[keep]
            keep = ~take
            rank, made = rank[keep], made[keep]
            at = here - np.arange(len(here))  # where the merged symbols are now
            for pair in (at[at > 0] - 1, at[at < len(rank)]):
                pair = pair[word[pair] == word[pair + 1]]
                rank[pair], made[pair] = self._looked_up(flat[pair], flat[pair + 1])
        return flat, word

    def _one_by_one(self, flat: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, pair by pair: of the best pairs of a word the leftmost first."""
        symbols, n = flat.tolist(), len(flat)
        able = np.flatnonzero(rank < _NO_RANK)
        heap = list(zip(rank[able].tolist(), able.tolist(), flat[able].tolist(), flat[able + 1].tolist()))
        heapq.heapify(heap)
        after = np.append(np.where(word[1:] == word[:-1], np.arange(1, n), n), n).tolist()
        before = np.append(-1, np.where(word[1:] == word[:-1], np.arange(n - 1), -1)).tolist()
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j == n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = self.pairs[a << 32 | b][1], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and symbols[left] >= 0 and symbols[right] >= 0:
                    found = self.pairs.get(symbols[left] << 32 | symbols[right])
                    if found:
                        heapq.heappush(heap, (found[0], left, symbols[left], symbols[right]))
        keep = np.array([x is not None for x in symbols])
        return np.array([x for x in symbols if x is not None], np.int64), word[keep]

    def _rounds(self, flat: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, words) after all merges of short words, in any order of words."""
        done_flat, done_word = [flat[:0]], [word[:0]]
        while len(flat):
            same = word[1:] == word[:-1]
            usable = same & (flat[1:] >= 0) & (flat[:-1] >= 0)
            key = np.where(usable, flat[:-1] << 32 | np.maximum(flat[1:], 0), -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rank = np.append(np.where(hit, self.rank[at], _NO_RANK), _NO_RANK)
            starts = np.flatnonzero(np.append(True, ~same))
            least = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(flat)))
            open_ = np.repeat(least < _NO_RANK, length)
            done_flat.append(flat[~open_]), done_word.append(word[~open_])
            least = np.repeat(least, length)
            best = np.flatnonzero((rank == least) & (least < _NO_RANK))
            # The leftmost place of each word always merges; others only at the same pair, unless the
            # pair is one that waits, and not where they overlap a place that merges.
            made = self.made[at[best]]
            first = np.append(True, word[best][1:] != word[best][:-1])
            lead = np.maximum.accumulate(np.where(first, np.arange(len(best)), 0))
            alike = (key[best] == key[best[lead]]) & ~self.eager[made]
            chain = np.append(False, np.diff(best) == 1)  # overlaps its left neighbour
            run = np.flatnonzero(~chain)
            place = np.arange(len(best)) - np.repeat(run, np.diff(np.append(run, len(best))))
            take = first | (alike & (place % 2 == 0))
            here = best[take]
            flat[here] = made[take]
            keep = open_
            keep[here + 1] = False
            flat, word = flat[keep], word[keep]
        return np.concatenate(done_flat), np.concatenate(done_word)

    def _learn(self, keys: list[str]) -> None:
        new = [k if k.startswith(MARK) else MARK + k for k in keys]
        at = 0
        while at < len(new):
            stop, total = at, 0
            while stop < len(new) and (total == 0 or total + len(new[stop]) <= ROUND_SYMBOLS):
                total += len(new[stop])
                stop += 1
            for key, word, symbols in zip(keys[at:stop], new[at:stop], self._merge(new[at:stop])):
                ids = symbols.tolist()
                if min(ids) < 0:
                    ids = [x for s in ids for x in ([s] if s >= 0 else [self.byte_ids[b] for b in chr(-1 - s).encode()])]
                self.memo[key] = np.array(ids, np.int32).tobytes()
                self.held += ENTRY + 4 * (len(key) + len(ids))
                if (decoded := self._joined(ids)) != word:
                    self.odd[key] = decoded
            at = stop

    def _joined(self, ids: list[int]) -> str:
        """The text of ids, marks still in place."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.control:
                out.append(self.pieces[i])
        return "".join(out) + held.decode("utf-8", "replace")

    def words(self, text: str) -> list[str]:
        """Keys of the independent words of a text."""
        if not text:
            return []
        if "  " in text or MARK in text or text[-1] == " " or text[0] == " ":
            found = _WORDS.findall(MARK + text.replace(" ", MARK))
            return [w[1:] if len(w) > 1 and w[1] != MARK else w for w in found]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """(ids with the end id, their decoded text) of each text."""
        cut = [self.words(x) for x in texts]
        new = set().union(*cut).difference(self.memo)
        if new:
            if self.held > MEMO_BYTES:
                self.memo.clear(), self.odd.clear()
                self.held = 0
                new = set().union(*cut)
            self._learn(list(new))
        get, odd, end, out = self.memo.__getitem__, self.odd, np.array([self.end], np.int32).tobytes(), []
        for words in cut:
            ids = np.frombuffer(b"".join(map(get, words)) + end, np.int32)
            text = "".join([odd[w] if w in odd else w if w[0] == MARK else MARK + w for w in words])
            text = text.replace(MARK, " ")
            out.append((ids, text[1:] if text[:1] == " " else text))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, such as ``encode`` made."""
        text = self._joined(ids).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=1)
def codec(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode_decode(docs: DataFrame, model: str | None = None, text_col: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each whole text, an end id last, and the text decoded from them.

    Null and empty texts have the end id alone and decode to an empty text; an empty table gives an
    empty one. Texts of any length go whole, words of any length too: their time grows about in
    proportion. Other columns, and repeated rows, stay as they are; columns named like the two new
    ones are replaced.
    """
    path = model or default_path()
    rest = [c for c in docs.columns if c not in (ids, decoded)]
    at = rest.index(text_col)
    own = docs.select(*("`" + c.replace("`", "``") + "`" for c in rest))
    kinds = T.StructType([*own.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from encoded(codec(path), batch, at, [*rest, ids, decoded])
        pa.default_memory_pool().release_unused()

    return own.transform(in_tasks, run, kinds)


def encoded(bpe: PieceBpe, batch: pa.RecordBatch, at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """``batch`` with the ids and decoded text of its column ``at``; its texts are Python's a slice of about ``SLICE`` bytes at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy()
    slices = np.maximum.accumulate((np.cumsum(sizes) - sizes) // SLICE)  # a slice for each ``SLICE`` bytes before a text
    cut = np.flatnonzero(np.append(True, slices[1:] != slices[:-1])).tolist() if len(sizes) else []
    for s, e in zip(cut, [*cut[1:], len(sizes)]):
        part = batch.slice(s, e - s)
        got = bpe.encode([x or "" for x in part.column(at).to_pylist()])
        cuts = pa.array(np.cumsum([0, *(len(x[0]) for x in got)]), pa.int32())
        lists = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([x[0] for x in got])))
        yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array([x[1] for x in got], pa.string())], names)
