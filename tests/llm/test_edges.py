"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.llm import decontamination, fingerprints, pieces, pseudonyms, quality, sharding, simhash, substrings, tokencounts, tokenstore
from veldt.llm.common import shared_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp int, tag string, shard string, unit double, ids string, place int, kind string, start string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [
    (1, "a b c d e f g", "en", "s", 13),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, " \n\t ", "en", "s", 4),
    (5, LONG, "en", "s", len(LONG)),
    (6, LONG + " tail", "en", "s", len(LONG) + 5),
    (7, "a b c d e f g", "fr", "t", 13),
    (None, "no id at all here", "en", "s", 17),
    (None, None, None, None, None),
    (8, "dup row", "en", "s", 7),
    (8, "dup row", "en", "s", 7),
    (9, "Straße ÉÀ 🙂 日本語 <|endoftext|> \x00 ▁ x  y", None, "s", 40),
    (-5, "word", "en", "s", 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "x", 1, "t", "s", 0.5, "i", 2, "k", "z") for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false").coalesce(1)


def ids(rows, name="id"):
    return Counter(r[name] for r in rows)


EXPECTED = Counter(r[0] for r in ROWS)


def test_simhash(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert ids(rows) == EXPECTED
    comp = defaultdict(set)
    for r in rows:
        comp[r["id"]].add(r["component_id"])
    assert comp[1] == comp[7] == {1}
    assert comp[2] == comp[3] == comp[4] == {2}  # the zero fingerprint links
    assert comp[8] == {8} and comp[None] == {2, None}
    assert all(r["fp"] == 0 for r in rows if r["id"] in (2, 3, 4))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert ids(kept.collect(), "doc_id") == Counter([1, 2, 5, None, 8, 9, -5])
    assert simhash.keep_one(empty).count() == 0


def test_keep_one_judges_rows_without_ids_by_their_groups(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[2]), (6, texts[3]), (6, texts[0])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert Counter(map(tuple, kept)) == Counter([(6, texts[0]), (None, texts[1]), (5, texts[2]), (6, texts[3])])


def test_token_store(spark, docs, empty):
    path = shared_path(spark, "t")
    tokenstore.write(docs, path)
    rows = sorted(tokenstore.checksums(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, -5, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9]
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[2] == 1
    own = {r["doc_id"]: r for r in tokenstore.documents(spark, path).collect()}
    for r in rows:
        if r["doc_id"] is not None:
            got = own[r["doc_id"]]["ids"]
            assert got[-1] == 2 and zlib.crc32(np.array(got, "<u4").tobytes()) == r["ids_crc32"]
    five = next(r for r in rows if r["doc_id"] == 5)
    assert tokenstore.ids_at(spark, path, five["start"] + 3, five["start"] + 9) == own[5]["ids"][3:9]
    none = shared_path(spark, "t")
    tokenstore.write(empty, none)
    assert tokenstore.checksums(spark, none).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 0, 1), (7, 1, 0), (None, 1, 0), (8, None, 0), (6, 0, 0), (-5, 1, 0)], "doc_id bigint, quality int, toxic int")
    features, model = quality.train(docs, labels)
    rows = quality.score(features, model).collect()
    assert ids(rows) == EXPECTED and all(0 <= r["score"] <= 1 for r in rows)
    _, flat = quality.train(docs, labels.where("false"))
    assert {r["score"] for r in quality.score(features, flat).collect()} == {0.5}
    _, one = quality.train(docs, labels.where("quality = 1"))
    assert {r["score"] for r in quality.score(features, one).collect()} == {1.0}
    kept = quality.keep_good(docs, labels, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert quality.keep_good(empty, labels).count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([("q1", "B c, D"), ("q2", None), (None, "a b"), ("q3", "..."), ("q4", " ".join(LONG.split()[100:140])), ("q5", "B c, D"), ("q1", "B c, D")], "item_id string, text string")
    marked = decontamination.mark(docs, bench)
    assert marked.columns == [*docs.columns, "contamination"]
    rows = {r["doc_id"]: r["contamination"] for r in marked.collect()}
    assert rows[1]["items"] == ["q1", "q5"] and [tuple(s) for s in rows[1]["spans"]] == [(1, 4)]
    assert rows[2]["n_words"] == rows[3]["n_words"] == 0 and rows[2]["spans"] == []
    assert rows[5]["items"] == ["q4"] and any(s["end"] - s["start"] >= 40 for s in rows[5]["spans"])
    # Many small blocks give the same as one.
    again = {r["doc_id"]: r["contamination"] for r in decontamination.mark(docs, bench, block_bytes=8).collect()}
    assert again == rows
    assert decontamination.mark(empty, bench).count() == 0
    assert all(not r["contamination"]["items"] for r in decontamination.mark(docs, bench.where("false")).collect())
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and not {1, 7} & set(ids(kept.collect(), "doc_id"))


def test_pieces(docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    out = pieces.encode_decode(docs)
    assert out.columns == [c for c in docs.columns if c != "ids"] + ["ids", "decoded"]
    rows = out.collect()
    assert ids(rows, "doc_id") == EXPECTED
    for r in rows:
        want = lib.encode(r["text"] or "") + [2]
        assert r["ids"] == want and r["decoded"] == lib.decode(want)
    assert pieces.encode_decode(empty).count() == 0


def test_pseudonyms(docs, empty):
    out = pseudonyms.pseudonymise(docs.withColumn("pii", F.lit(1)), "k")
    assert out.columns == [*docs.columns, "pii"]
    rows = out.collect()
    assert ids(rows, "doc_id") == EXPECTED
    before = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert Counter((r["doc_id"], r["text"]) for r in rows) == before
    assert pseudonyms.pseudonymise(empty, "k").count() == 0


def test_token_counts(docs, empty):
    text = F.col("text")
    rows = tokencounts.count(docs, text, "lines").collect()
    assert ids(rows) == EXPECTED
    for r in rows:
        assert sum(s["tokens"] for s in r["sections"]) + r["n_outside"] == r["n_tokens"]
    assert {r["id"]: len(r["sections"]) for r in rows}[2] == 0
    assert tokencounts.count(empty, text, tokencounts.line_sections(text)).count() == 0


def test_substrings(docs, empty):
    rows = substrings.deduplicate(docs).collect()
    assert ids(rows) == EXPECTED
    own = {r["id"]: r for r in rows}
    assert own[6]["n_removed"] == 60_000 and own[6]["kept"] == "tail"
    assert own[2]["n_words"] == 0 and own[2]["kept"] == "" and own[8]["kept"] == "dup row"
    assert substrings.deduplicate(empty).count() == 0


def test_fingerprints(docs, empty):
    rows = fingerprints.compare_with_next(docs).collect()
    assert ids(rows) == EXPECTED
    own = {r["id"]: r for r in rows}
    assert own[2]["v"] == own[3]["v"] and own[2]["n_chars"] == 0
    assert own[1]["v"] == own[7]["v"] != own[9]["v"]
    assert own[2]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    assert fingerprints.compare_with_next(empty).count() == 0
    alone = fingerprints.compare_with_next(docs.where("doc_id = 1")).first()
    assert alone["near_next"] == 1.0


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 3).collect()
    assert ids(rows) == EXPECTED
    for k in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert {r["id"]: r["size"] for r in rows}[2] == 1
    assert sharding.shard(empty, 3).count() == 0


def test_odd_column_names_stay(spark):
    words = "a b c d e f g h i j k l m n"
    docs = spark.createDataFrame([(1, words), (2, None)], "doc_id bigint, text string")
    docs = docs.withColumn("odd ` name", F.struct(F.lit(1).alias("a b"), F.lit("x").alias("c`d"))).withColumn("a.b:c", F.array(F.lit(1)))
    items = spark.createDataFrame([("x", words[2:] + " o"), ("y", words[:25])], "item_id string, text string")
    coded = pieces.encode_decode(docs).collect()
    assert coded[0]["decoded"] == words and coded[0]["odd ` name"]["a b"] == 1 and coded[1]["a.b:c"] == [1]
    marked = {r["doc_id"]: r for r in decontamination.mark(docs, items).collect()}
    assert marked[1]["contamination"]["items"] == ["x", "y"] and marked[1]["odd ` name"]["c`d"] == "x"
    assert [r["doc_id"] for r in decontamination.drop_contaminated(docs, items).collect()] == [2]
