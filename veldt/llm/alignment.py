"""Alignment of two tokenizers over the same texts, and how often their ids go together in the corpus.

A byte-level BPE (A) encodes a space and the text, a SentencePiece BPE (B) the text, before which it
puts the space itself. Where tokens of both end at one byte, a group ends; all A tokens of a group
link with all its B tokens. A pair of ids counts the documents that hold it linked, and is best if no
other pair of its A id counts more.

Texts are cut where both tokenizers always cut: before spaces after other characters, and around
single line ends. A worker aligns each such part once and remembers it, up to a bound. A slice of
documents then leaves, for each stripe of A ids (id modulo the number of stripes), the pairs that its
documents hold, packed in a few arrays. Counting deals these by stripe, adds them with ``np.add.at``
into a dense block of (ids of the stripe) x (B ids), and finds the best of each A id as its row's
maximum. Scoring deals the links in the same way, a few stripes to a task, next to the totals of
these stripes, and adds up for each slice of documents. Both deal the slices of many input partitions by
a salt too, so that no stripe's task grows with the corpus: blocks of one stripe are added in two steps.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm import bytebpe, pieces
from veldt.llm.common import in_tasks, materialize

STRIPES = 256  # of A ids; a dense block of one is 50 MB with vocabularies of 50,000 and 32,000 ids
BANDS = 64  # tasks that score the links of the same documents
SALTED = 10  # links of 2 to this power input partitions are counted and scored together
SLICE = 2_000_000  # characters that are aligned together, one text at least
MEMO_BYTES = 144 << 20  # what a worker remembers of parts, beside those of one slice
TOGETHER = 256  # parts that go to the byte-level tokenizer in one text
ENTRY = 400  # bytes of a remembered part, beside its characters, groups and pairs
_CUTS = re.compile(r"(?<=\S)(?= )|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
GROUPS = ("text", "digest")
MADE = "batch bigint, place int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, stripe int, cells binary, n binary, docs binary, mult binary"


class PlainBytes(bytebpe.ByteBpe):
    """The byte-level encoder; strings of special tokens inside texts are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.odd = re.compile(r"\s")

    def in_order(self, keys: list[str]) -> list[str]:
        """Keys in the order of ``rows``: plain words, words at a line's begin, and what has white space of its own."""
        kinds: tuple[list[str], ...] = ([], [], [])
        for k in keys:
            line = k[0] == "\n"
            kinds[2 if self.odd.search(k, line) or len(k) == line else line].append(k)
        return [k for x in kinds for k in x]

    def rows(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in a row, how many each has) of keys in order; parts without white space go to the library together."""
        plain = [k for k in keys if k[0] != "\n" and not self.odd.search(k)]
        lines = [k[1:] for k in keys[len(plain) :] if k[0] == "\n" and len(k) > 1 and not self.odd.search(k, 1)]
        alone = [bytebpe._part(k) for k in keys[len(plain) + len(lines) :]]
        texts = [" " + "\n ".join(plain[s : s + TOGETHER]) for s in range(0, len(plain), TOGETHER)]
        texts += ["\n".join(lines[s : s + TOGETHER]) for s in range(0, len(lines), TOGETHER)]
        flat, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for one in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(one.ids, np.int64)
            ends = np.append(np.flatnonzero(ids == bytebpe._END), len(ids))
            sizes.append(np.diff(ends, prepend=-1) - 1)
            flat.append(ids[ids != bytebpe._END])
        for one in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False):
            flat.append(np.array(one.ids, np.int64))
            sizes.append(np.array([len(one.ids)]))
        flat, sizes = np.concatenate(flat), np.concatenate(sizes)
        if len(sizes) != len(keys):
            raise RuntimeError("a part was not encoded on its own")
        return flat, sizes


def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _pack(x: np.ndarray) -> bytes:
    """Non-negative whole numbers in the narrowest type, which the first byte tells."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _pack_ascending(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=0))


def _unpack_ascending(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw))


class Both:
    """The two tokenizers, and what they make of the parts that a worker has seen."""

    def __init__(self, a_path: str, b_path: str, stripes: int):
        self.a, self.b = PlainBytes(a_path), pieces.PieceBpe(b_path)
        self.n_a, self.n_b, self.stripes = self.a.size, len(self.b.pieces), stripes
        self.rows = -(-self.n_a // stripes)
        self.cells = self.rows * self.n_b  # of a stripe
        self.cuttable = self.a.simple and not any("\n" in p for p in self.b.ids)
        alphabet = _byte_alphabet()
        self.a_bytes, self.b_bytes = [b""] * self.n_a, [p.replace(pieces.MARK, " ").encode() for p in self.b.pieces]
        for token, i in self.a.tokenizer.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token)
        for i, token in self.a.tokenizer.get_added_tokens_decoder().items():
            self.a_bytes[i] = token.content.encode()
        for i, byte in self.b.bytes.items():
            self.b_bytes[i] = bytes([byte])
        for i in (*self.b.control, self.b.unk):
            self.b_bytes[i] = b""
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        #: Ids as they are written: those of A with a comma, or a bar after a group's last; then those of B with a comma or a semicolon.
        self.written = [f"{i}{x}" for i in range(self.n_a) for x in ",|"] + [f"{i}{x}" for i in range(self.n_b) for x in ",;"]
        self.written_size = np.array(list(map(len, self.written)), np.int64)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []  # each with a semicolon at its end
        self.counts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links of each part
        self.whole = np.zeros(0, bool)  # both tokenizers give the part's bytes
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # each part's pairs
        self.pair, self.mult = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)  # slices that had the part, less what is forgotten with time
        self.held = 0

    def _shrink(self) -> None:
        """Keep the parts that several slices had, the more frequent half of all parts at most."""
        keep = np.argsort(-self.hits, kind="stable")[: len(self.hits) // 2]
        keep = np.sort(keep[self.hits[keep] > 1])
        keys = list(self.index)
        self.index = {keys[i]: k for k, i in enumerate(keep.tolist())}
        self.groups = [self.groups[i] for i in keep.tolist()]
        size = self.size[keep]
        place = np.repeat(self.first[keep] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.pair, self.mult, self.first, self.size = self.pair[place], self.mult[place], np.cumsum(size) - size, size
        self.counts, self.whole, self.hits = self.counts[keep], self.whole[keep], self.hits[keep] // 2
        self.held = ENTRY * len(keep) + sum(map(len, self.index)) + sum(map(len, self.groups)) + 16 * len(self.pair)

    def parts(self, text: str) -> list[str]:
        """Keys of the parts of a space and the text: what follows a leading space, or a line end and the part."""
        if not text:
            return []
        if not self.cuttable:
            return ["\n " + text]
        if bytebpe._has_runs(text):
            return [x[1:] if x[0] == " " and len(x) > 1 and x[1] != "\n" else "\n" + x for x in _CUTS.split(" " + text)]
        return text.replace("\n", " \n\n \n").split(" ")

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(B ids of all texts in a row, how many each has)."""
        words, at, found, sizes = [x.replace(" ", pieces.MARK) for x in texts], 0, [], []
        while at < len(words):
            stop, total = at, 0
            while stop < len(words) and (total == 0 or total + len(words[stop]) <= pieces.ROUND_SYMBOLS):
                total += len(words[stop])
                stop += 1
            flat, size = self.b.merged(words[at:stop])
            # A character that is no piece gives the ids of its bytes.
            odd, back = np.unique(flat[flat < 0], return_inverse=True)
            raw = [[self.b.byte_ids[b] for b in chr(-1 - c).encode()] for c in odd.tolist()]
            width = np.ones(len(flat), np.int64)
            width[flat < 0] = np.array(list(map(len, raw)), np.int64)[back]
            own = np.repeat(flat, width)
            own[own < 0] = np.array([i for c in back.tolist() for i in raw[c]], np.int64)
            found.append(own), sizes.append(np.bincount(np.repeat(np.repeat(np.arange(len(size)), size), width), minlength=len(size)))
            at = stop
        return np.concatenate(found), np.concatenate(sizes)

    def _learn(self, keys: list[str]) -> None:
        keys = self.a.in_order(keys)
        texts = [bytebpe._part(k) for k in keys]
        flat_a, size_a = self.a.rows(keys)
        flat_b, size_b = self._pieces(texts)
        whole, flat_a, size_a, flat_b, size_b = self._checked(texts, flat_a, size_a, flat_b, size_b)
        # All parts lie in one row of bytes; a part's last byte ends a token of both.
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        part_a = np.repeat(np.arange(len(keys)), size_a)
        part = part_a[np.cumsum(in_a) - 1] if len(common) else np.zeros(0, np.int64)  # of each group
        n_groups, n_links = np.bincount(part, minlength=len(keys)), np.zeros(len(keys), np.int64)
        np.add.at(n_links, part, in_a * in_b)
        pair, mult, owner = self._pairs(flat_a, group_a, flat_b, group_b, part)
        size = np.bincount(owner, minlength=len(keys))
        first = np.cumsum(size) - size + len(self.pair)
        self.counts = np.concatenate([self.counts, np.stack([size_a, size_b, n_groups, n_links], 1)])
        self.whole = np.append(self.whole, whole)
        self.first, self.size = np.append(self.first, first), np.append(self.size, size)
        self.hits = np.append(self.hits, np.zeros(len(keys), np.int64))
        self.pair, self.mult = np.append(self.pair, pair), np.append(self.mult, mult)
        # A group's ids of A come before those of B; each is written with what follows it.
        item = np.zeros(len(flat_a) + len(flat_b), np.int64)
        ahead_b, ahead_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
        item[np.arange(len(flat_a)) + ahead_b[group_a]] = 2 * flat_a + np.append(group_a[1:] != group_a[:-1], True)[: len(flat_a)]
        item[np.arange(len(flat_b)) + ahead_a[group_b]] = 2 * (self.n_a + flat_b) + np.append(group_b[1:] != group_b[:-1], True)[: len(flat_b)]
        written = "".join(map(self.written.__getitem__, item.tolist()))
        cut = np.append(0, np.cumsum(self.written_size[item]))[np.append(0, np.cumsum(size_a + size_b))].tolist()
        self.index.update(zip(keys, range(len(self.index), len(self.index) + len(keys))))
        self.groups += [written[s:e] for s, e in zip(cut, cut[1:])]
        self.held += ENTRY * len(keys) + sum(map(len, texts)) + len(written) + 16 * len(pair)

    def _checked(self, texts: list[str], flat_a: np.ndarray, size_a: np.ndarray, flat_b: np.ndarray, size_b: np.ndarray):
        """Whether both tokenizers give the bytes of each text, and ids and sizes without the texts of which they don't."""
        raw = [x.encode() for x in texts]
        whole = np.ones(len(texts), bool)
        for flat, size, token in ((flat_a, size_a, self.a_bytes), (flat_b, size_b, self.b_bytes)):
            tokens = list(map(token.__getitem__, flat.tolist()))
            end = np.cumsum(size).tolist()
            n = np.bincount(np.repeat(np.arange(len(size)), size), list(map(len, tokens)), len(size))
            if b"".join(tokens) != b"".join(raw) or (n != list(map(len, raw))).any():
                whole &= np.array([b"".join(tokens[s:e]) == x for s, e, x in zip([0, *end], end, raw)])
        if not whole.all():
            flat_a, flat_b = flat_a[np.repeat(whole, size_a)], flat_b[np.repeat(whole, size_b)]
            size_a, size_b = size_a * whole, size_b * whole
        return whole, flat_a, size_a, flat_b, size_b

    def _pairs(self, flat_a: np.ndarray, group_a: np.ndarray, flat_b: np.ndarray, group_b: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, how often, part) of the distinct pairs of each part, by part and pair.

        A pair is (its A id's stripe, row in the stripe, B id) as one number. Ids that a group
        repeats are counted before they are paired.
        """
        own_a, times_a = np.unique(group_a * self.n_a + flat_a, return_counts=True)
        own_b, times_b = np.unique(group_b * self.n_b + flat_b, return_counts=True)
        of_a, of_b = own_a // self.n_a, own_b // self.n_b
        width = np.bincount(of_b, minlength=len(part))
        row = np.repeat(np.arange(len(own_a)), width[of_a])
        ahead = np.cumsum(width[of_a]) - width[of_a]
        col = np.repeat((np.cumsum(width) - width)[of_a] - ahead, width[of_a]) + np.arange(len(row))
        a, b = (own_a % self.n_a)[row], (own_b % self.n_b)[col]
        code = ((a % self.stripes) * self.rows + a // self.stripes) * self.n_b + b
        span = self.stripes * self.cells
        found, back = np.unique(part[of_a[row]] * span + code, return_inverse=True)
        mult = np.zeros(len(found), np.int64)
        np.add.at(mult, back, times_a[row] * times_b[col])
        return found % span, mult, found // span

    def align(self, texts: list[str], digest: bool):
        """(counts of each text, groups of each text, links as (pair, text, how often) by pair and text)."""
        cut = [self.parts(x) for x in texts]
        new = set().union(*cut).difference(self.index)
        if new and self.held > MEMO_BYTES:
            self._shrink()
            new = set().union(*cut).difference(self.index)
        if new:
            self._learn(list(new))
        at = [list(map(self.index.__getitem__, keys)) for keys in cut]
        if not self.whole.all():
            at = [x if self.whole[x].all() else [] for x in at]
        groups = ["".join(map(self.groups.__getitem__, x))[:-1] for x in at]
        if digest:
            groups = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups]
        doc, part = np.repeat(np.arange(len(texts)), list(map(len, at))), np.array([i for x in at for i in x], np.int64)
        counts = np.zeros((len(texts), 4), np.int64)
        np.add.at(counts, doc, self.counts[part])
        span = max(len(self.index), 1)
        held, times = np.unique(doc * span + part, return_counts=True)
        doc, part = held // span, held % span
        self.hits[np.unique(part)] += 1
        size = self.size[part]
        place = np.repeat(self.first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pair, doc, mult = self.pair[place], np.repeat(doc, size), self.mult[place] * np.repeat(times, size)
        key = pair * len(texts) + doc
        order = np.argsort(key)
        key = key[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        mult = np.add.reduceat(mult[order], start) if len(key) else mult
        return counts, groups, key[start] // len(texts), key[start] % len(texts), mult


@lru_cache(maxsize=1)
def both(a_path: str, b_path: str, stripes: int) -> Both:
    return Both(a_path, b_path, stripes)


def encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", groups: str = "text", a: str | None = None, b: str | None = None, stripes: int = STRIPES) -> DataFrame:
    """Each document's groups and counts, and the links of slices of documents by stripe, in one written table.

    A row of a document has ``place``, its place in its ``batch``; a row of links has ``stripe``.
    """
    if groups not in GROUPS:
        raise ValueError(f"groups is one of {GROUPS}")
    a, b = a or bytebpe.default_path(), b or pieces.default_path()
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.DataType.fromDDL(MADE).fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = both(a, b, stripes)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            kinds = dict(zip(names, [ids.type, pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int32(), *[pa.binary()] * 4]))
            for s, e in bytebpe.batches_of(texts, SLICE):
                counts, written, pair, doc, mult = own.align(texts[s:e], groups == "digest")
                rows = {"id": ids.slice(s, e - s), "batch": np.full(e - s, number), "place": np.arange(e - s, dtype=np.int32), "groups": written}
                rows |= {k: counts[:, i] for i, k in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                yield _record(kinds, rows, e - s)
                links: dict[str, list] = {k: [] for k in ("stripe", "cells", "n", "docs", "mult")}
                cuts = np.searchsorted(pair, np.arange(stripes + 1) * own.cells)
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    at = slice(cuts[k], cuts[k + 1])
                    cell, n = np.unique(pair[at] - k * own.cells, return_counts=True)
                    for name, x in zip(links, (k, _pack_ascending(cell), _pack(n), _pack(doc[at]), _pack(mult[at]))):
                        links[name].append(x)
                yield _record(kinds, {"batch": np.full(len(links["n"]), number), **links}, len(links["n"]))
                number += 1

    return materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(in_tasks, run, schema), "alignment")


def _record(kinds: dict[str, pa.DataType], given: dict, n: int) -> pa.RecordBatch:
    """A batch of the given columns, the others null."""
    columns = [pa.nulls(n, t) if k not in given else given[k] if isinstance(given[k], pa.Array) else pa.array(given[k], t) for k, t in kinds.items()]
    return pa.RecordBatch.from_arrays(columns, list(kinds))


_SALT = f"shiftright(batch, {32 + SALTED}) AS salt"
TOTALS = "stripe int, salt bigint, cells binary, n binary, best binary"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


def _added(table: DataFrame, cells: int, columns: int, last: bool) -> DataFrame:
    """Counts of each (stripe, salt), added in a dense block; the last step marks the best of each A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = np.zeros(cells, np.int64), None
        for stripe, salt, cell, n in _rows(batches):
            if now is not None and now != (stripe, salt):
                yield total(block, *now)
                block[:] = 0
            now = (stripe, salt)
            np.add.at(block, _unpack_ascending(cell), _unpack(n))
        if now is not None:
            yield total(block, *now)

    def total(block: np.ndarray, stripe: int, salt: int) -> pa.RecordBatch:
        at, best = np.flatnonzero(block), b""
        if last:
            best = _pack((block[at] == block.reshape(-1, columns).max(1)[at // columns]).astype(np.int64))
        values = [pa.array([stripe], pa.int32()), pa.array([salt], pa.int64()), *(pa.array([x], pa.binary()) for x in (_pack_ascending(at), _pack(block[at]), best))]
        return pa.RecordBatch.from_arrays(values, ["stripe", "salt", "cells", "n", "best"])

    dealt = table.select("stripe", "salt", "cells", "n").repartition("stripe", "salt").sortWithinPartitions("stripe", "salt")
    return dealt.transform(in_tasks, run, TOTALS)


def totals(made: DataFrame, cells: int, columns: int) -> DataFrame:
    """(stripe, cells, n, best): how many documents hold each pair of a stripe, packed."""
    links = made.where("stripe is not null").select("stripe", F.expr(_SALT), "cells", "n")
    once = _added(links, cells, columns, False).withColumn("salt", F.lit(0).cast("bigint"))
    return materialize(_added(once, cells, columns, True).drop("salt"), "link-counts")


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, tuple] = {}
    task = now = None
    best, total = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def flush() -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *(pa.array([x], pa.binary()) for x in (_pack_ascending(at), _pack(best[at]), _pack(total[at])))], ["batch", "docs", "n_best", "count_sum"])

    for band, salt, kind, batch, stripe, cells, n, docs, mult in _rows(batches):
        if now is not None and (kind == 0 or batch != now):
            yield flush()
            now = None
        if task != (band, salt):
            task, known = (band, salt), {}
        if kind == 0:
            known[stripe] = (_unpack_ascending(cells), _unpack(n), _unpack(docs))
            continue
        if now is None:
            now, best, total = batch, np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(known[stripe][0], _unpack_ascending(cells))
        times, doc, mult = _unpack(n), _unpack(docs), _unpack(mult)
        if (short := int(doc.max()) + 1 - len(total)) > 0:
            best, total = np.append(best, np.zeros(short, np.int64)), np.append(total, np.zeros(short, np.int64))
        np.add.at(total, doc, mult * np.repeat(known[stripe][1][at], times))
        np.add.at(best, doc, mult * np.repeat(known[stripe][2][at], times))
    if now is not None:
        yield flush()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def flush() -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], ["batch", "place", "n_best", "count_sum"])

    for batch, docs, own_best, own_total in _rows(batches):
        if batch != now:
            if now is not None:
                yield flush()
            now, best, total = batch, np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = _unpack_ascending(docs)
        if (short := int(doc.max()) + 1 - len(total)) > 0:
            best, total = np.append(best, np.zeros(short, np.int64)), np.append(total, np.zeros(short, np.int64))
        best[doc] += _unpack(own_best)
        total[doc] += _unpack(own_total)
    if now is not None:
        yield flush()


def score(made: DataFrame, counts: DataFrame) -> DataFrame:
    """(batch, place, n_best, count_sum) of each document with links."""
    band = F.pmod("stripe", F.lit(BANDS)).alias("band")
    links = made.where("stripe is not null").select(band, F.expr(_SALT), F.lit(1).alias("kind"), "batch", "stripe", "cells", "n", "docs", "mult")
    salts = made.where("stripe is not null").select("stripe", F.expr(_SALT)).distinct()
    known = counts.join(salts, "stripe").select(band, "salt", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("batch"), "stripe", "cells", "n", F.col("best").alias("docs"), F.lit(None).cast("binary").alias("mult"))
    dealt = known.unionByName(links).repartition("band", "salt").sortWithinPartitions("band", "salt", "kind", "batch")
    parts = dealt.transform(in_tasks, _score, "batch bigint, docs binary, n_best binary, count_sum binary")
    return parts.repartition("batch").sortWithinPartitions("batch").transform(in_tasks, _gather, "batch bigint, place int, n_best bigint, count_sum bigint")


def _shape(a: str | None, b: str | None, stripes: int) -> tuple[int, int]:
    """(cells of a stripe's block, B ids)."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    n_a = Tokenizer.from_file(a or bytebpe.default_path()).get_vocab_size(with_added_tokens=True)
    n_b = SentencePieceProcessor(model_file=b or pieces.default_path()).get_piece_size()
    return -(-n_a // stripes) * n_b, n_b


def link_counts(docs: DataFrame, text_col: str = "text", a: str | None = None, b: str | None = None, stripes: int = STRIPES) -> DataFrame:
    """(a, b, n_docs, best): how many documents hold each pair of ids linked, and whether no other of its A id has more."""
    cells, columns = _shape(a, b, stripes)
    made = encode(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "text", "id", "digest", a, b, stripes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stripe, cell, n, best in _rows(batches):
            at = _unpack_ascending(cell)
            yield pa.RecordBatch.from_arrays([pa.array(at // columns * stripes + stripe), pa.array(at % columns), pa.array(_unpack(n)), pa.array(_unpack(best) == 1)], ["a", "b", "n_docs", "best"])

    return totals(made, cells, columns).select("stripe", "cells", "n", "best").transform(in_tasks, run, "a bigint, b bigint, n_docs bigint, best boolean")


def align(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", groups: str = "text", a: str | None = None, b: str | None = None, stripes: int = STRIPES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row of ``docs``.

    ``groups`` holds the alignment as ``a1,a2|b1;a3|b2,b3``, or with ``"digest"`` the SHA-256 of that.
    Null and empty texts, and texts of which a tokenizer does not give back the bytes (such as those
    with a U+2581), have no tokens: zeros and an empty string. Repeated rows are documents of their
    own and each counts; null ids stay; ties for the best count are all best; other columns are not
    read, whatever their names. An empty table gives an empty one. Texts go whole; a text without a
    place to cut is one part, and a group's distinct ids are paired in one task.
    """
    cells, columns = _shape(a, b, stripes)
    made = encode(docs, text_col, id_col, groups, a, b, stripes)
    scored = score(made, totals(made, cells, columns))
    own = made.where("stripe is null").select("batch", "place", "id", "n_a", "n_b", "n_groups", "n_links", "groups")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    return own.join(scored, ["batch", "place"], "left").select("id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups")
