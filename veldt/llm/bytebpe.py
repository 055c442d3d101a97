"""Byte-level BPE of whole texts with the tokenizers library, one call for each new word only.

The vocabulary's splitting rule always cuts before a space that a non-space follows, and around a
single line end between non-spaces, so the parts between such cuts encode independently. A worker
keeps the ids of the parts that it has seen, up to a bound in bytes, and passes the others to the library
together. Texts with other runs of white space are cut before spaces only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

DEFAULT = "byte_bpe_50k.json"
MEMO_BYTES = 256 << 20  # what a worker remembers, beside the parts of one batch
ENTRY = 200  # bytes of a remembered part, beside its characters and ids
_TOGETHER = 256  # parts that go to the library in one text
_RUNS = re.compile(r"\s\s|^\s|\s$")
_CUT = re.compile(r"(?<!^)(?= \S)")
_END = 198  # the id of a line end


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


class ByteBpe:
    """Ids, and the character spans of ids, of texts; nothing is added at either end.

    A part is held by a key: its text after one leading space, or a line end and its text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([r"\s", *map(re.escape, self.special)]))
        self.simple = self._encode("\n").ids == [_END]  # else every text goes to the library whole
        self.memo: dict[str, bytes] = {}
        self.held = 0
        # A token of the byte alphabet has a character for each of its bytes.
        self.bytes = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes[i] = len(token.content.encode())

    def _encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def keys(self, text: str) -> list[str]:
        """Keys of the parts of a text; the parts joined are the text."""
        if not text:
            return []
        if not self.simple or any(x in text for x in self.special):
            return ["\n" + text]
        if _has_runs(text):
            return [x[1:] if x[0] == " " and len(x) > 1 and x[1] != "\n" else "\n" + x for x in _CUT.split(text)]
        return ("\n" + text.replace("\n", " \n\n \n")).split(" ")

    def _learn(self, new: list[str]) -> None:
        if not self.simple:
            return self._learn_alone(new)
        lines, words = [k for k in new if k[0] == "\n"], [k for k in new if k[0] != "\n"]
        self._learn_together(lines, 1, lambda keys: "".join(keys)[1:])
        self._learn_together(words, 0, lambda keys: " " + "\n ".join(keys))

    def _learn_together(self, keys: list[str], skip: int, text_of: Callable[[list[str]], str]) -> None:
        """Learn parts in texts that hold each in a line of its own; ``text_of`` writes such a text.

        Parts with white space after their first ``skip`` characters, or with special tokens, go alone.
        """
        odd = self.odd.search
        for at in range(0, len(keys), _TOGETHER):
            group = keys[at : at + _TOGETHER]
            if odd("".join([k[skip:] for k in group]) if skip else "".join(group)):
                self._learn_alone([k for k in group if odd(k, skip)])
                group = [k for k in group if not odd(k, skip)]
            if not group:
                continue
            (got,) = self.tokenizer.encode_batch_fast([text_of(group)], add_special_tokens=False)
            ids = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(ids == _END) * 4
            if len(ends) != len(group) - 1:
                raise RuntimeError("a part was not encoded on its own")
            raw, ends = ids.tobytes(), ends.tolist()
            self.memo.update(zip(group, [raw[s:e] for s, e in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)])]))
            self.held += ENTRY * len(group) + sum(map(len, group)) + len(raw)

    def _learn_alone(self, keys: list[str]) -> None:
        for key in keys:
            self.memo[key] = np.array(self._encode(_part(key)).ids, np.uint32).tobytes()
            self.held += ENTRY + 4 * len(key) + len(self.memo[key])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        cut = [self.keys(x) for x in texts]
        found = [list(map(self.memo.get, keys)) for keys in cut]
        gaps = [[i for i, x in enumerate(got) if x is None] for got in found]
        self._learn(list({keys[i] for keys, at in zip(cut, gaps) for i in at}))
        for keys, got, at in zip(cut, found, gaps):
            for i in at:
                got[i] = self.memo[keys[i]]
        return [np.frombuffer(b"".join(got), np.uint32) for got in found]

    def spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first character, end character) of each text's tokens.

        The tokens' bytes are the text's bytes in order. A character of several tokens lies in the
        span of each of them.
        """
        out = []
        for text, ids in zip(texts, self.ids(texts)):
            end = np.cumsum(self.bytes[ids])
            start = end - self.bytes[ids]
            raw = text.encode()
            if len(raw) != len(text):
                char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
                start, end = char[start], char[end - 1] + 1
            out.append((ids, start, end))
        return out


def _has_runs(text: str) -> bool:
    """White space at an end, or next to other white space."""
    if text.replace("\n", "").isprintable():  # then spaces and line ends are its only white space
        return text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    return _RUNS.search(text) is not None


def _part(key: str) -> str:
    return key[1:] if key[0] == "\n" else " " + key


@lru_cache(maxsize=1)
def encoder(path: str) -> ByteBpe:
    """The worker's encoder of a vocabulary file."""
    return ByteBpe(path)


def batches_of(texts: list[str], chars: int = 4_000_000):
    """Slices (from, to) of ``texts`` of about ``chars`` characters, one text at least."""
    at, total = 0, 0
    for i, x in enumerate(texts):
        total += len(x)
        if total >= chars:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
