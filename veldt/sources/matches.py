"""A data source of staged event files: one JSON file for each match, in any folders below a root.

    matches.read(spark, root, "match_id string, id string, type string", only={"type": "Pass"})

A file holds a list of events, or an object with a list ``events``; it may be packed with gzip. A partition is a file, or where
there are more than ``slices`` of them a run of files that are read one after another, so a task's memory is one match and
``BATCH`` rows. ``match_id``, from the file's name, is added to each event. Events that
differ from ``only`` are dropped before a row is made, and files of other matches are not opened.
Columns that the schema doesn't name are not built. With the option ``report`` the source gives a row of
status for each match instead.

The selection is an option and not a pushed filter: Spark 4.1.2 keeps a source's pushed filters for all
plans of one DataFrame, so a table that is read twice under different filters loses rows.
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from veldt.session import ship
from veldt.sources.files import system_of

STATUS = "match_id string, status string, message string, n_events bigint"
SLICES = 512  # partitions at least, if there are as many files
FILES = 2000  # of one partition at most
BATCH = 4096  # rows that are given to Spark at once
_MATCH = re.compile(r"([0-9]+)[^0-9/]*$")
_NAME = re.compile(r"\.json(\.gz)?$")


class MatchFiles(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(files[0][0] if files else "")
        self.files = files  # (path, match)


class MatchEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "match_events"

    def schema(self) -> str:
        if self._reports():
            return STATUS
        raise ValueError("match_events needs a schema")

    def _reports(self) -> bool:
        return self.options.get("report", "false").lower() == "true"

    def reader(self, schema: StructType) -> MatchReader:
        return MatchReader(self.options["path"], schema, self._reports(), json.loads(self.options.get("only", "{}")), int(self.options.get("slices", SLICES)))


class MatchReader(DataSourceReader):
    def __init__(self, root: str, schema: StructType, reports: bool, only: dict[str, str], slices: int):
        self.root, self.schema, self.reports, self.only, self.slices = root, schema, reports, only, slices

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, top = system_of(self.root)
        found = system.get_file_info(fs.FileSelector(top, recursive=True))
        out = []
        for info in sorted(found, key=lambda x: x.path):
            name = info.path.rsplit("/", 1)[-1]
            number = _MATCH.search(_NAME.sub("", name))
            if info.type == fs.FileType.File and _NAME.search(name) and number:
                out.append((info.path, number.group(1)))
        out = [x for x in out if self.only.get("match_id", x[1]) == x[1]]
        n = min(len(out), max(self.slices, -(-len(out) // FILES)))
        return [MatchFiles(out[len(out) * i // n : len(out) * (i + 1) // n]) for i in range(n)] or [MatchFiles([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held = []
        for path, match_id in partition.files:
            held += [self._status(path, match_id)] if self.reports else self._wanted(path, match_id)
            if len(held) >= BATCH:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _wanted(self, path: str, match_id: str) -> list[dict]:
        events = [e for e in self._events(path) if all(_text(e.get(k)) == v for k, v in self.only.items() if k != "match_id")]
        return [e | {"match_id": match_id} for e in events]

    def _status(self, path: str, match_id: str) -> dict:
        try:
            return {"match_id": match_id, "status": "success", "message": None, "n_events": len(self._events(path))}
        except Exception as e:  # a status is the purpose of this row
            return {"match_id": match_id, "status": "failed", "message": f"{type(e).__name__}: {e}"[:200], "n_events": 0}

    def _events(self, path: str) -> list[dict]:
        system = system_of(self.root)[0]
        with system.open_input_stream(path, compression=None) as f:
            raw = f.read()
        found = json.loads(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
        events = found.get("events") if isinstance(found, dict) else found
        if not isinstance(events, list) or not all(isinstance(e, dict) for e in events):
            raise ValueError(f"no list of events in {path}")
        return events

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        columns = []
        for f in self.schema.fields:
            kind, values = to_arrow_type(f.dataType), [r.get(f.name) for r in rows]
            columns.append(pa.array([_text(v) for v in values] if pa.types.is_string(kind) else values, kind))
        return pa.RecordBatch.from_arrays(columns, [f.name for f in self.schema.fields])


def _text(value) -> str | None:
    """A value as a string column holds it: nested ones as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def stage(events: DataFrame, root: str, match: str = "match_id", packed: bool = False) -> int:
    """Write the events of each match as one JSON list, ``events_<match>.json``, from tasks; how many files that are.

    A file that a lost task has begun is written anew by its next attempt. Events without a match are left out.
    """
    kept = [c for c in events.columns if c != match]
    rows = events.where(F.col(match).isNotNull()).groupBy(F.col(match).cast("string").alias("match")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*kept)))).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = system_of(root)
        system.create_dir(top, recursive=True)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = body.encode()
                with system.open_output_stream(f"{top}/events_{name}.json{'.gz' if packed else ''}", compression=None) as f:
                    f.write(gzip.compress(raw, mtime=0) if packed else raw)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    ship(events.sparkSession)
    return rows.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def read(spark: SparkSession, root: str, schema: str = "", only: dict[str, str] | None = None, report: bool = False, slices: int = SLICES) -> DataFrame:
    """The staged events below ``root`` whose values, as text, are those of ``only``; or with ``report`` a row of status for each match."""
    spark.dataSource.register(MatchEvents)
    reader = spark.read.format("match_events").option("only", json.dumps(only or {})).option("slices", slices)
    return (reader.option("report", "true") if report else reader.schema(schema)).load(root)
