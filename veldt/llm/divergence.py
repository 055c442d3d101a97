"""Which sources of a language differ, and by which terms.

The first pass counts in how many documents of its language each term is. A language keeps the terms
of enough documents. The second pass counts their occurrences in each (language, source) group with
an Aho-Corasick automaton of the kept terms, each padded with its delimiter, over the texts with
every delimiter made a space. Kept terms are read in blocks of bounded size, one written pass over the
texts a block, so a worker's automaton does not grow with the corpus.

A group's share of a term is p = 1 + floor(UNIT * (count + 5) / (N + 5 V)), of whole numbers all
through: N is the group's occurrences of all V kept terms of its language. Groups are held as sparse
postings, the terms they have. Two groups differ by the sum over all kept terms of the difference of
their shares, of which terms that neither has are a product, terms of one come from sums over its
postings, and terms of both from the postings of each term.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import in_tasks, materialize

UNIT = 1_000_000_000
PRIOR = 5
LEAST = 30  # documents of its language that a kept term is in, at least
BLOCK_BYTES = 24 << 20  # of kept terms that one pass looks for
TOGETHER = 4_000_000  # differences that a task makes at once
HELD = 1_000_000  # counts that a task holds before it passes them on
#: Every delimiter becomes a space, A-Z become a-z; bytes of other characters stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_GROUP = ("lang", "source")


def _given(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n_docs): in how many documents of the language the term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.setdefault(lang, Counter()).update(set(text.as_py().encode().translate(_FOLD).split()))
            if sum(map(len, seen.values())) > HELD:
                yield flush(seen)
                seen = {}
        yield flush(seen)

    def flush(seen: dict[str, Counter]) -> pa.RecordBatch:
        langs = [x for x, own in seen.items() for _ in range(len(own))]
        terms = [t.decode() for own in seen.values() for t in own]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.string()), pa.array([n for own in seen.values() for n in own.values()], pa.int64())], ["lang", "term", "n"])

    found = docs.select("lang", "text").transform(in_tasks, run, "lang string, term string, n bigint")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n_docs"))


def _occurrences(docs: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """(lang, source, term, n) of the given (lang, term) pairs, added up within tasks."""
    sent, name = docs.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _automata(name, sent.value)
        seen: dict[tuple[str, str], Counter] = {}
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if lang in known:
                    padded = b" " + text.as_py().encode().translate(_FOLD) + b" "
                    seen.setdefault((lang, source), Counter()).update(map(itemgetter(1), known[lang].iter(padded.decode())))
            if sum(map(len, seen.values())) > HELD:
                yield flush(seen)
                seen = {}
        yield flush(seen)

    def flush(seen: dict[tuple[str, str], Counter]) -> pa.RecordBatch:
        rows = [(lang, source, sent.value[k][1], n) for (lang, source), own in seen.items() for k, n in own.items()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "term", "n"])

    return docs.transform(in_tasks, run, "lang string, source string, term string, n bigint")


_BUILT: dict[str, dict] = {}


def _automata(block: str, terms: list[tuple[str, str]]) -> dict:
    """The worker's automaton of each language of a block of (language, term); only those of one block are kept."""
    if block not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        made: dict = {}
        for k, (lang, term) in enumerate(terms):
            made.setdefault(lang, ahocorasick.Automaton()).add_word(f" {term} ", k)
        for one in made.values():
            one.make_automaton()
        _BUILT[block] = made
    return _BUILT[block]


def postings(docs: DataFrame, kept: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, term, n) with n > 0: occurrences of each kept term in each group."""
    size = kept.agg(F.sum(F.octet_length("lang") + F.octet_length("term"))).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("lang", "term"), F.lit(parts))
    out = None
    for k in range(parts):
        terms = [tuple(r) for r in kept.where(block == k).select("lang", "term").toLocalIterator()]
        once = materialize(_occurrences(docs, terms).groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "postings")
        out = once if out is None else out.unionByName(once)
    return out


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 terms)), exact for any whole numbers; null without kept terms."""
    wide = [c.cast("decimal(20, 0)") for c in (n, total, terms)]
    top = (wide[0] + F.lit(PRIOR).cast("decimal(2, 0)")) * F.lit(UNIT).cast("decimal(11, 0)")
    below = wide[1] + wide[2] * F.lit(PRIOR).cast("decimal(2, 0)")
    return F.call_function("div", top, F.nullif(below, F.lit(0))) + 1


def _pairs(rows: DataFrame) -> DataFrame:
    """(lang, i, j, value): what postings add to the difference of groups i < j over that of terms that neither has.

    ``rows`` hold for a term its groups' places in their language (``at``, ascending), their shares (``p``)
    and, of all the language's groups, the shares of a term that they don't have (``zero``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            size = batch.column(1).value_lengths().to_numpy()
            at, p = (batch.column(i).flatten().to_numpy() for i in (1, 2))
            term, of = np.repeat(np.arange(len(langs)), size), np.repeat(langs, size)
            for lang in dict.fromkeys(langs):
                own = of == lang
                zero = np.array(batch.column(3)[int(np.argmax(langs == lang))].as_py(), np.int64)
                _add(sums.setdefault(lang, np.zeros((len(zero), len(zero)), np.int64)), term[own], at[own], p[own], zero)
        for lang, total in sums.items():
            i, j = np.nonzero(np.triu(total, 1))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i), pa.array(j), pa.array(total[i, j])], ["lang", "i", "j", "value"])

    return rows.transform(in_tasks, run, "lang string, i bigint, j bigint, value bigint").groupBy("lang", "i", "j").agg(F.sum(F.col("value").cast("decimal(38, 0)")).alias("value"))


def _add(total: np.ndarray, term: np.ndarray, at: np.ndarray, p: np.ndarray, zero: np.ndarray) -> None:
    """Add the terms' differences to the upper triangle of ``total``; places ascend within a term."""
    for i in range(len(zero)):
        own = np.flatnonzero(at == i)
        if not len(own):
            continue
        base = np.abs(zero[i] - zero)
        # As if no other group had the terms of i: for groups before i the sum goes to their row.
        alone, step = -base * len(own), max(1, TOGETHER // len(zero))
        for s in range(0, len(own), step):
            alone += np.abs(p[own[s : s + step]][:, None] - zero[None, :]).sum(0)
        total[i, i + 1 :] += alone[i + 1 :]
        total[:i, i] += alone[:i]
        # Groups after i that have the term too: their shares take the place of both estimates.
        mine = np.full(int(term.max()) + 1, -1)
        mine[term[own]] = p[own]
        both = np.flatnonzero((at > i) & (mine[term] >= 0))
        j, q, r = at[both], p[both], mine[term[both]]
        np.add.at(total[i], j, np.abs(r - q) - np.abs(r - zero[j]) - np.abs(zero[i] - q) + base[j])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources are apart, and the terms that set each apart.

    Part ``pair`` has every other source of the language, by the difference of their shares over all
    kept terms (0 without any). Part ``term`` has the ``top`` terms that a group has and of which its share is
    larger than the language's, by that difference. Equal values rank by item, in the order of their
    UTF-8 bytes. Null text, language and source are empty strings, which are groups like others;
    groups without terms are there; repeated rows count as documents of their own; an empty table
    gives an empty one; other columns are not read, whatever their names. Texts go whole.
    """
    given = _given(docs, text_col, lang_col, source_col)
    frequent = materialize(document_frequencies(given).where(F.col("n_docs") >= least).select("lang", "term"), "kept-terms")
    held = postings(given, frequent, block_bytes)
    terms = frequent.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = held.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
    groups = given.select(*_GROUP).distinct().join(totals, [*_GROUP], "left").join(terms, "lang", "left")
    groups = groups.select(*_GROUP, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialize(groups.withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))).withColumn("at", place), "groups")
    shared = held.join(groups.select(*_GROUP, "at", "total", "v"), [*_GROUP])
    shared = materialize(shared.select(*_GROUP, "at", "term", "n", "v", share(F.col("n"), F.col("total"), F.col("v")).alias("p")), "shares")
    return _distances(groups, shared).unionByName(_telling(shared, top))


def _ranked(rows: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item"))


def _distances(groups: DataFrame, shared: DataFrame) -> DataFrame:
    zeros = groups.where("v > 0").groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "zero"))), lambda x: x["zero"]).alias("zero"))
    entry = F.array_sort(F.collect_list(F.struct("at", "p")))
    by_term = shared.groupBy("lang", "term").agg(entry.alias("held")).join(zeros, "lang")
    extra = _pairs(by_term.select("lang", F.transform("held", lambda x: x["at"]).alias("at"), F.transform("held", lambda x: x["p"]).alias("p"), "zero"))
    one = groups.select("lang", F.col("source").alias("left"), F.col("at").alias("i"), F.col("zero").alias("z"), "v")
    other = groups.select("lang", F.col("source").alias("right"), F.col("at").alias("j"), F.col("zero").alias("y"))
    couples = one.join(other, "lang").where("i < j").join(extra, ["lang", "i", "j"], "left")
    base = F.col("v").cast("decimal(18, 0)") * F.abs(F.col("z") - F.col("y")).cast("decimal(18, 0)")
    couples = couples.withColumn("value", F.when(F.col("v") > 0, base + F.coalesce("value", F.lit(0))).otherwise(0).cast("bigint"))
    both = couples.select("lang", "value", F.explode(F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("item")), F.struct(F.col("right").alias("source"), F.col("left").alias("item")))).alias("x"))
    rows = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    return rows.withColumn("rank", _ranked(rows))


def _telling(shared: DataFrame, top: int) -> DataFrame:
    whole = shared.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.max("v").alias("v"))
    sizes = whole.groupBy("lang").agg(F.sum("all_n").alias("all_total"))
    q = share(F.col("all_n"), F.col("all_total"), F.col("v"))
    known = whole.join(sizes, "lang").select("lang", "term", q.alias("q"))
    rows = shared.join(known, ["lang", "term"]).where("p > q").select(*_GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return rows.withColumn("rank", _ranked(rows)).where(F.col("rank") <= top)
