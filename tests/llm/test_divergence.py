"""The source audit against plain Python whole numbers."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from veldt.llm import divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    rows = [(a or "", b or "", WORD.findall((t or "").translate(LOWER))) for a, b, t in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in rows:
        df[lang].update(set(words))
        counts[lang, source].update(words)
    kept = {lang: sorted(t for t, n in own.items() if n >= least) for lang, own in df.items()}
    groups = sorted({r[:2] for r in rows})

    def shares(own, terms):
        total = sum(own[t] for t in terms)
        return {t: 1 + 1_000_000_000 * (own[t] + 5) // (total + 5 * len(terms)) for t in terms}

    out = []
    p = {g: shares(counts[g], kept.get(g[0], [])) for g in groups}
    for g in groups:
        terms = kept.get(g[0], [])
        q = shares(sum((counts[h] for h in groups if h[0] == g[0]), Counter()), terms)
        pairs = [(sum(abs(p[g][t] - p[h][t]) for t in terms), h[1]) for h in groups if h[0] == g[0] and h != g]
        own = [(p[g][t] - q[t], t) for t in terms if counts[g][t] > 0 and p[g][t] > q[t]]
        for part, found, limit in (("pair", pairs, None), ("term", own, top)):
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
            out += [(*g, part, item, value, k + 1) for k, (value, item) in enumerate(found)]
    return Counter(out)


def texts(n, words, step):
    return [" ".join(words[(i * step + j * j) % len(words)] for j in range(9)) for i in range(n)]


WORDS = ["The", "of-the", "Größe", "ǅa", "日本", "a1b", "x", "y_z", "É", "end.", "mid\x00dle", "🙂", "tEn"]
ROWS = (
    [("en", f"s{i % 4}", t) for i, t in enumerate(texts(120, WORDS, 3))]
    + [("de", "only", t) for t in texts(9, WORDS, 5)]
    + [("fr", "a", "rare words"), ("fr", "b", None), ("fr", None, ""), (None, None, "x x x"), (None, "s", "x y"), ("en", "silent", "... 12"), ("en", "s1", None)]
    + [("en", "s0", "The The The")] * 5
)
SCHEMA = "lang string, source string, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit(1)).withColumn("zero", F.lit(1)).withColumn("odd `. n", F.lit(1)).repartition(5)


def test_all_groups_pairs_and_terms(spark):
    for least, top in ((2, 50), (6, 3), (10_000, 5)):
        got = divergence.audit(docs(spark, ROWS), least=least, top=top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert Counter(map(tuple, got.collect())) == plain(ROWS, least, top)


def test_blocks_of_terms_and_of_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "TOGETHER", 5)
    got = divergence.audit(docs(spark, ROWS), least=2, block_bytes=40)
    assert Counter(map(tuple, got.collect())) == plain(ROWS, 2, 50)


def test_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = spark.createDataFrame([("en", "s", "word")], SCHEMA)
    assert divergence.audit(alone, least=1).collect() == []  # a source alone is its language


def test_shares_of_counts_beyond_64_bits(spark):
    big = 4_000_000_000_000_000
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(7 * big + 1), F.lit(10**9)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert row["p"] == 1 + 10**9 * (big + 5) // (7 * big + 1 + 5 * 10**9) and row["none"] is None
