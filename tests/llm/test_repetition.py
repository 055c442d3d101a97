"""The repetition rules against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from veldt.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines)}
    later = [x for i, x in enumerate(lines) if x in lines[:i]]
    out |= {"n_dup_lines": len(later), "dup_line_chars": sum(len(w) for x in later for w in WORD.findall(x))}

    def covered(n, least):
        at = {}
        for i in range(len(words) - n + 1):
            at.setdefault(tuple(words[i : i + n]), []).append(i)
        return {i + k for own in at.values() if len(own) > 1 for i in own[least:] for k in range(n)}

    out["n_repeat_words"] = len(covered(3, 0))
    return out | {f"repeat_chars_{n}": sum(len(words[i]) for i in covered(n, 1)) for n in repetition.LENGTHS}


def test_counts_of_random_and_odd_texts(spark):
    random.seed(3)
    words = ["a", "bb", "Straße", "日本", "🙂", "#x", "<|>", "\x00", "\x1c", "\xa0", "…", "100%"]
    gaps = [" ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b"]
    rows = [(i, "".join(random.choice(words[: 3 + i % 10]) + random.choice(gaps) for _ in range(random.randint(0, 70)))) for i in range(300)]
    rows += [(None, "one line\none line\none line"), (1, None), (2, ""), (3, " \n\t\n"), (4, "same"), (4, "same"), (9005, "x " * 40_000), (9006, " ".join(map(str, range(60_000))))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("repetition", F.lit("old")).withColumn("n_words", F.lit(1)).withColumn("odd `. n", F.struct(F.lit(1).alias("a b"))).repartition(4)
    got = repetition.count_repetition(docs)
    assert got.columns == ["doc_id", "text", "n_words", "odd `. n", "repetition"]
    small = [r for r in rows if len(r[1] or "") < 10_000]
    found = Counter((r["doc_id"], r["text"], tuple(r["repetition"])) for r in got.collect())
    for i, t in small:
        assert (i, t, tuple(plain(t)[k] for k in got.schema["repetition"].dataType.names)) in found
    (x,) = [m for (i, _, m) in found if i == 9005]
    assert x[0] == x[6] == 40_000 and x[7] == 39_999
    (y,) = [m for (i, _, m) in found if i == 9006]
    assert y[0] == 60_000 and y[6:] == (0,) * 7
    assert repetition.count_repetition(docs.where("false")).count() == 0


def test_verdicts(spark):
    fine = " ".join(f"word{i}" for i in range(80))
    rows = [(1, fine), (2, " ".join(fine.split()[:49])), (3, " ".join(fine.split()[:50])), (4, fine + " " + fine), (5, fine + " #" * 9), (6, fine + " " + "# " * 12)]
    rows += [(7, "\n".join([fine, "a line", "a line", "a line", "a line", "a line"])), (8, None), (9, fine + " " + " ".join(fine.split()[:12])), (10, fine + "\n" + " ".join(fine.split()[:6]))]
    kept = repetition.keep_varied(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert kept.columns == ["doc_id", "text"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 10]
    assert {r["doc_id"] for r in repetition.count_repetition(spark.createDataFrame(rows, "doc_id bigint, text string")).where(repetition.base_failed()).collect()} == {2, 4, 8}
