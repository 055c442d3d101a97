"""Token counts of fields and sections, attributed by character offsets.

Each whole document is encoded once. Its tokens' character spans are joined with the spans of its
sections, and a token that crosses a section's end is given away by an explicit rule:

    first    to the section of its first character
    most     to the section with most of its characters, the earlier one if two have as many
    split    to all sections it touches, in proportion to its characters in each

A token outside all sections counts for the document alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import in_tasks

from veldt.llm import bytebpe

RULES = ("first", "most", "split")
SECTION = "struct<name: string, start: int, end: int>"


def line_sections(text: Column) -> Column:
    """Paragraphs, the runs of text between line ends, as sections; each has its line end within it.

    A text of n line ends has n + 1 sections, the last of which may be empty; null has none.
    """
    lines = F.split(text, "\n", -1)
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SECTION}>").alias("out"))

    def step(a: Column, line: Column) -> Column:
        end = F.least(a["at"] + F.char_length(line) + 1, F.char_length(text))
        name = F.concat(F.lit("paragraph "), F.size(a["out"]).cast("string"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(name.alias("name"), a["at"].alias("start"), end.alias("end")))).alias("out"))

    return F.when(text.isNotNull(), F.aggregate(lines, first, step, lambda a: a["out"])).otherwise(first["out"])


def joined_fields(fields: list[str], separator: str = "\n") -> tuple[Column, Column]:
    """(text, sections) of a document made of string columns; null fields are empty."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    sections, at = [], F.lit(0)
    for name, value in zip(fields, values):
        end = at + F.char_length(value)
        sections.append(F.struct(F.lit(name).alias("name"), at.cast("int").alias("start"), end.cast("int").alias("end")))
        at = end + len(separator)
    return F.concat_ws(separator, *values), F.array(*sections)


def attribute(start: np.ndarray, end: np.ndarray, s_start: np.ndarray, s_end: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; sections are disjoint and ascending, tokens ascending."""
    out = np.zeros(len(s_start))
    full = s_end > s_start  # empty sections hold no token
    places, a, b = np.flatnonzero(full), s_start[full], s_end[full]
    if not len(places) or not len(start):
        return out
    low = np.searchsorted(b, start, side="right")  # the first section that ends after the token's start
    high = np.searchsorted(a, np.maximum(end, start + 1), side="left")  # sections before it begin before the token's end
    if rule == "first":
        inside = (low < len(a)) & (a[np.minimum(low, len(a) - 1)] <= start)
        np.add.at(out, places[low[inside]], 1)
        return out
    touched = np.maximum(high - low, 0)
    token = np.repeat(np.arange(len(start)), touched)
    section = np.repeat(low - np.cumsum(touched) + touched, touched) + np.arange(touched.sum())
    shared = np.minimum(np.maximum(end, start + 1)[token], b[section]) - np.maximum(start[token], a[section])
    if rule == "split":
        np.add.at(out, places[section], shared / np.maximum(end - start, 1)[token])
        return out
    order = np.lexsort((section, -shared, token))
    best = order[np.append(True, np.diff(token[order]) != 0)] if len(order) else order
    np.add.at(out, places[section[best]], 1)
    return out


def _line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    end = np.cumsum([len(x) + 1 for x in text.split("\n")])
    return np.append(0, end[:-1]), np.minimum(end, len(text))


def _given_spans(own: list[dict]) -> tuple[list[str], np.ndarray, np.ndarray]:
    own = sorted(own, key=lambda x: (x["start"], x["end"]))
    a, b = (np.array([x[k] for x in own], np.int64) for k in ("start", "end"))
    if (a[1:] < b[:-1]).any():
        raise ValueError("sections overlap")
    return [x["name"] for x in own], a, b


def count(docs: DataFrame, text: Column, sections: Column | str, rule: str = "first", tokenizer: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, n_outside, sections: array of (name, start, end, tokens)) for every row.

    ``sections`` are disjoint spans of characters, in any order; overlapping ones are an error.
    ``"lines"`` stands for the text's ``line_sections``, which are then found in the tasks. Null
    texts are empty: no tokens, and 0 in every section. Characters of several tokens count each
    token whole. Null ids and repeated rows stay as they are; extra columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = tokenizer or bytebpe.default_path()
    lines = isinstance(sections, str)
    if lines and sections != "lines":
        raise ValueError("sections are a column, or lines")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bytebpe.encoder(path)
        for batch in batches:
            given = batch.column(1).to_pylist()
            texts = [x or "" for x in given]
            for s, e in bytebpe.batches_of(texts):
                n, names, starts, ends, tokens = [], [], [], [], []
                spans = [None] * (e - s) if lines else batch.column(2).slice(s, e - s).to_pylist()
                for k, (ids, start, end) in enumerate(enc.spans(texts[s:e])):
                    if not lines:
                        own, a, b = _given_spans(spans[k] or [])
                    elif given[s + k] is None:
                        own, a, b = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
                    else:
                        a, b = _line_spans(texts[s + k])
                        own = [f"paragraph {i}" for i in range(len(a))]
                    n.append(len(ids)), names.extend(own), starts.append(a), ends.append(b)
                    tokens.append(attribute(start, end, a, b, rule))
                outside = np.array(n) - np.array([x.sum() for x in tokens])
                cuts = pa.array(np.cumsum([0, *map(len, starts)]), pa.int32())
                struct = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(tokens))], ["name", "start", "end", "tokens"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(n, pa.int64()), pa.array(outside, pa.float64()), pa.ListArray.from_arrays(cuts, struct)], ["id", "n_tokens", "n_outside", "sections"])

    given = docs.select(F.col(id_col).alias("id"), text.alias("text"), *([] if lines else [sections.alias("sections")]))
    return given.transform(in_tasks, run, f"id {kind}, n_tokens bigint, n_outside double, sections array<struct<name: string, start: int, end: int, tokens: double>>")
