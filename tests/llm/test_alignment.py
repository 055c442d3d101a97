"""Tokenizer alignment against the two libraries and plain Python, from the contract alone."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.conftest import SF
from veldt.llm import alignment, bytebpe, pieces, queries

BITS = [" ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "a", "the", "Straße", "É", "🙂", "日本語", "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", "\x00", "\x1c", "\xa0", "\x85", "'s", "123", "12345678", "!!", "x" * 40, "ab" * 30, "ﬁ", "ｆ", "hello", "World", " I"]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        self.byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}

    def groups(self, text):
        if not text:
            return []
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in ids_a]
        b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(a) == b"".join(b) == (" " + text).encode():
            return []
        out, own, at_a, at_b = [], ([], []), 0, 0
        while ids_a or ids_b:
            if at_a <= at_b:
                own[0].append(ids_a.pop(0))
                at_a += len(a.pop(0))
            else:
                own[1].append(ids_b.pop(0))
                at_b += len(b.pop(0))
            if at_a == at_b:
                out.append(own)
                own = ([], [])
        return out

    def table(self, rows):
        """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each (id, text)."""
        found = [(i, self.groups(t)) for i, t in rows]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
        count = Counter(k for x in links for k in x)
        best = defaultdict(int)
        for (a, _), n in count.items():
            best[a] = max(best[a], n)
        out = []
        for (i, g), own in zip(found, links):
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for k, n in own.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in own.items()), text))
        return out, count, best


@pytest.fixture(scope="module")
def plain():
    return Plain()


COLUMNS = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def test_texts_with_odd_white_space_marks_and_repeats(spark, plain):
    random.seed(5)
    rows = [(i, "".join(random.choices(BITS, k=random.randint(0, 14)))) for i in range(700)]
    rows += [(None, "no id"), (7, "the the the"), (7, "the the the"), (701, None), (702, ""), (703, " "), (704, "one " * 5000), (705, "z" * 20_000), (706, "\n" * 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("batch", F.lit("x")).withColumn("stripe", F.lit(1)).withColumn("odd `. name", F.lit(1)).repartition(5)
    got = alignment.align(docs, stripes=16)
    assert got.columns == COLUMNS
    want, count, best = plain.table(rows)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    pairs = alignment.link_counts(docs, stripes=16).collect()
    assert {(r["a"], r["b"]): r["n_docs"] for r in pairs} == dict(count)
    assert all(r["best"] == (r["n_docs"] == best[r["a"]]) for r in pairs)


def test_totals_of_many_salts_meet(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "_SALT", "shiftright(batch, 32) AS salt")
    rows = [(i, f"the cat {i % 7} sat, on the mat. Straße {i % 3}!") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert Counter(map(tuple, alignment.align(docs, stripes=8).collect())) == Counter(plain.table(rows)[0])


def test_an_empty_table_and_no_tokens(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align(empty).collect() == [] and alignment.link_counts(empty).collect() == []
    none = spark.createDataFrame([(1, None), (2, ""), (3, "a ▁ b")], "doc_id bigint, text string")
    for how in alignment.GROUPS:
        assert [tuple(r)[1:] for r in alignment.align(none, groups=how).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_what_is_remembered_is_bounded(monkeypatch):
    own = alignment.Both(bytebpe.default_path(), pieces.default_path(), 8)
    monkeypatch.setattr(alignment, "MEMO_BYTES", 20_000)
    texts = [" ".join(f"w{i * j}" for j in range(30)) for i in range(40)]
    alone = [alignment.Both.align(own, [t], False)[1][0] for t in texts]
    assert own.held < 80_000 and len(own.index) < 200 and "w0" in own.index  # the part of all texts stays
    own._forget()
    fresh = own.align(texts, False)
    assert fresh[1] == alone
    own._shrink()
    own.align(["w0 w5 w7 w9"], False), own.align(["w0 w5"], False), own._shrink()
    assert set(own.index) == {"w0", "w5"}
    again = own.align(texts, False)
    assert again[1] == alone and all((x == y).all() for x, y in zip(again[2:], fresh[2:])) and (again[0] == fresh[0]).all()


def test_whole_query(spark, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in plain.table(rows)[0]]
    got = queries.QUERIES["op11_tokenizer_alignment"](spark, SF)
    assert got.columns == ["doc_id", *COLUMNS[1:-1], "groups_sha256"] and all(t == "bigint" for _, t in got.dtypes[:-1])
    assert Counter(map(tuple, got.collect())) == Counter(want)
