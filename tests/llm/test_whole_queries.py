"""Registered queries without SQL, over whole tables, against plain versions."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from tests.conftest import SF
from veldt.llm import bytebpe, pieces, pseudonyms, quality, queries, sharding

MASK = (1 << 62) - 1


def documents():
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return sorted((r["doc_id"], r["text"] or "") for r in rows)


def given():
    """(doc_id, text) as they are, nulls included."""
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


def plain_fingerprint(text):
    """(identity lanes, words, 64 likeness lanes)."""
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in text.split("\n")]
    ids = [sum(xxhash.xxh64_intdigest(struct.pack("<i", s), seed=h) & MASK for h in hashes) & MASK for s in range(4)]
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return ids, len(words), [sum(w >> j & 1 for w in words) for j in range(64)]


def plain_text(ids, n, lanes):
    return "".join(f"{x:016x}" for x in [*ids, n, *(lanes[j] | lanes[j + 32] << 32 for j in range(32))])


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    x, y = (2.0 * np.array(v[2]) - v[1] for v in (a, b))
    length = (x * x).sum() + (y * y).sum()
    return min(max(0.0, 1 - ((x - y) ** 2).sum() / length) if length else 0.0, 1 - 2.0**-20)


def test_token_ids(spark):
    library = Tokenizer.from_file(bytebpe.default_path())
    want, start = {}, 0
    for i, text in documents():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op2_token_id_output(spark, SF).collect()}
    assert got == want


def test_quality_scores(spark):
    """The discriminant written out with inverse covariances, on the operator's own statistics."""
    docs = documents()
    x = np.array([quality.statistics(t) for _, t in docs])
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in docs])
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    y = np.array([-1 if h else labels.get(i, -1) for (i, _), h in zip(docs, held)])
    d, known = x.shape[1], y >= 0
    scatter = [(x[y == k] - x[y == k].mean(0)).T @ (x[y == k] - x[y == k].mean(0)) for k in (0, 1)]
    pooled = sum(scatter) / known.sum()
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled)) + 0.05 * np.eye(d)
    logs = []
    for k in (0, 1):
        n = (y == k).sum()
        w = 0.9 * n / (n + d)
        cov = w * scatter[k] / n + (1 - w) * pooled + 0.05 * np.eye(d)
        z = x - x[y == k].mean(0)
        logs.append(np.log(n / known.sum()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    want = 1 / (1 + np.exp(0.25 * (logs[0] - logs[1])))
    got = queries.op3_quality_classifier(spark, SF).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in docs] and [r["held_out"] for r in got] == held.tolist()
    score = np.array([r["score"] for r in got])
    assert np.allclose(score, want, rtol=1e-6, atol=1e-9)
    assert [r["predicted"] for r in got] == (score >= 0.7).astype(int).tolist()


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_replace_values_and_nothing_else(spark):
    """Each text is its values' pseudonyms, each found from the value alone, with all between them as it was."""
    pattern = re.compile(pseudonyms.PATTERN)
    docs = documents()
    found = sorted({m for _, t in docs for m in pattern.findall(t)})
    alone = pseudonyms.pseudonymise(spark.createDataFrame([(v,) for v in found], "old string").selectExpr("old", "old AS text"), "key of the test tables")
    new = {r["old"]: (r["text"], r["pii"]) for r in alone.collect()}
    got = {r["doc_id"]: r for r in queries.op6_pii_pseudonyms(spark, SF).collect()}
    assert len(got) == len(docs)
    compared = 0
    for i, text in docs:
        values = pattern.findall(text)
        runs = [v for v in values if re.fullmatch(pseudonyms.RUN, v) and not re.fullmatch(pseudonyms.SSN, v) and new[v][1] != ["card"]]
        if runs:  # the text around such a run decides, which other tests look at
            continue
        compared += len(values)
        assert (got[i]["text"] or "") == pattern.sub(lambda m: new[m[0]][0], text)
        assert got[i]["pii"] == [k for v in values for k in new[v][1]] and got[i]["n_found"] == len(got[i]["pii"])
    assert compared > 0.8 * sum(len(pattern.findall(t)) for _, t in docs) > 0
    forms = {"email": str.lower, "card": lambda v: re.sub(r"\D", "", v)}
    for kind in pseudonyms.KINDS:
        form = forms.get(kind, str)
        pairs = {(form(old), form(text)) for old, (text, kinds) in new.items() if kinds == [kind]}
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
        assert kind != "card" or all(luhn(b) for _, b in pairs)


def test_fingerprints_and_edits(spark):
    docs = documents()[::-1]
    got = {r["doc_id"]: r for r in queries.op9_document_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, other, following = map(plain_fingerprint, (text, edited, after))
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == plain_text(*own) and r["edited_fingerprint"] == plain_text(*other)
        assert abs(r["near_edited"] - plain_likeness(own, other)) < 1e-9 and abs(r["near_next"] - plain_likeness(own, following)) < 1e-9


def test_op1_whole(spark):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    prints = {}
    for i, t in given():
        w = words.findall((t or "").translate(lower))
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    at = {i: i for i in prints}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    own = sorted(prints)
    for a in own:
        for b in own:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                at[y] = x
    want = {(i, f"{p:016x}", root(i)) for i, p in prints.items()}
    got = queries.QUERIES["op1_simhash_near_dedup"](spark, SF).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == want


def test_op5_whole(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.default_path())
    want = set()
    for i, t in given():
        ids = model.encode(t or "") + [model.eos_id()]
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    got = queries.QUERIES["op5_sentencepiece_codec"](spark, SF).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_op7_whole(spark):
    model = Tokenizer.from_file(bytebpe.default_path())
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_token_counts"](spark, SF).collect()}
    rows = given()
    assert len(got) == len(rows)
    for i, t in rows:
        found = model.encode(t or "", add_special_tokens=False)
        ends, at = [], 0
        for line in (t or "").split("\n"):
            at = min(at + len(line) + 1, len(t or ""))
            ends.append(at)
        count = [0] * len(ends)
        for start, _ in found.offsets:
            count[next(k for k, e in enumerate(ends) if start < e)] += 1
        assert (got[i]["n_tokens"], got[i]["n_sections"], got[i]["n_outside"]) == (len(found.ids), len(ends) if t is not None else 0, 0)
        assert got[i]["section_tokens"] == (count if t is not None else [])


def shards_hold_the_law(rows, shards, bound):
    """Slots without gaps, sizes near equal, equal texts together."""
    sums, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for text, shard, slot, size in rows:
        assert size == len((text or "").encode()) + 1 and 0 <= shard < shards
        sums[shard] += size
        slots[shard].append(slot)
        where[text].add(shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sums.values()) - min(sums[k] for k in range(shards)) <= bound * sum(sums.values()) / shards
    assert all(len(v) == 1 for v in where.values())


def test_op10_whole(spark):
    texts = dict(given())
    got = queries.QUERIES["op10_sharding"](spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(texts.keys())
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    shards_hold_the_law([(texts[r["doc_id"]], r["shard"], r["slot"], r["size"]) for r in got], 8, 0.01)


@pytest.mark.parametrize("fine", [1, 16, 10**9])
def test_op10_law_holds_whatever_is_bundled(spark, monkeypatch, fine):
    monkeypatch.setattr(sharding, "FINE", fine)
    rows = [(i, f"text {i % 2500} " + "y" * (i * 7919 % 300)) for i in range(3000)] + [(9000 + i, t) for i, t in enumerate([None, "", " a b ", "\t\n", "c"])]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 4).collect()
    texts = dict(rows)
    shards_hold_the_law([(texts[r["id"]], r["shard"], r["slot"], r["size"]) for r in got], 4, 0.01)
    assert all(r["tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["id"]] or "")) for r in got)
