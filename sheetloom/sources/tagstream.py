"""A data source for drawings kept as tag streams: lines that alternate between a group code and its value.

`spark.read.format("tags").load(path)` gives a row an entity. Files are read in splits of any size: an entity starts where a
line holds the code 0 and the next one a type's name, and no value can be taken for that, because behind a value stands a code, which is a
number. A split reads from the first entity that starts in it to the end of the last one, so any split size gives the same rows.

* Options: path (a file or folder), splitBytes (default 32 MB), mode (PERMISSIVE, DROPMALFORMED, FAILFAST), maxTasks (default 256): neighbouring
  splits of a file are read by one task, in one pass, so that there are about so many tasks, as long as none gets over 32 MB.
* A record that breaks the format, or whose numbers cannot be read, keeps what could be read, and its whole text in _corrupt_record.
* A schema that is given names the columns that are parsed. Options only.type, only.handle, only.owner and only.layer list values
  (a JSON array) to which reading is confined; records that do not have one of them are not parsed further. Spark's own hook for filters
  keeps what one scan pushed for all scans of the same frame, which loses rows when a frame is used twice, so it is not used.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sheetloom.sources.stages import checkpointed

POINTS = "array<struct<x:double,y:double>>"
SCHEMA = f"file string, ord long, type string, handle string, owner string, layer string, style string, text string, flags int, height double, x double, y double, width_factor double, box_width double, rotation double, block string, xscale double, yscale double, vertices {POINTS}, closed boolean, cells array<string>, _corrupt_record string"
SPLIT_BYTES = 32 << 20
#: Tasks that splits are dealt to, unless that makes one larger than SPLIT_BYTES.
MAX_TASKS = 256
BATCH_ROWS = 2000
#: Columns by which reading can be confined.
FILTERED = {"type", "handle", "owner", "layer"}
#: Group codes of the columns that are one value.
CODES = {"handle": 5, "owner": 330, "layer": 8, "style": 7, "height": 40, "flags": 70, "rotation": 50}
NAME = re.compile(rb"[A-Z][A-Z0-9_]*\r?$")


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class Record:
    """The tags of one entity; wrong collects what could not be read."""

    def __init__(self, offset: int, lines: list[bytes]) -> None:
        self.offset, self.lines, self.wrong = offset, lines, len(lines) % 2 == 1
        self.type = lines[1].decode().rstrip("\r")  # a name of capitals, or no entity would begin here

    @cached_property
    def tags(self) -> list[tuple[int, str]]:
        """Parsed when first asked for, as reading confined to other types never asks."""
        out: list[tuple[int, str]] = []
        for k in range(0, len(self.lines) - 1, 2):
            try:
                out.append((int(self.lines[k]), self.lines[k + 1].decode().rstrip("\r")))
            except ValueError:  # not a number, or not UTF-8
                self.wrong = True
        return out

    def first(self, code: int) -> str | None:
        return next((v for c, v in self.tags if c == code), None)

    def number(self, value: str | None, kind: type = float) -> float | int | None:
        if value is None:
            return None
        try:
            out = kind(value)
        except ValueError:
            out = None
        if out is None or out != out or out in (float("inf"), float("-inf")):
            self.wrong = True
            return None
        return out

    def text(self) -> str | None:
        parts = [v for c, v in self.tags if c == 3] + [v for c, v in self.tags if c == 1]
        return "".join(parts).replace("^J", "\n") if parts and self.type != "ACAD_TABLE" else None

    def vertices(self) -> list[dict[str, float | None]] | None:
        """Points of a line or polyline; each y belongs to the x before it."""
        if self.type not in ("LINE", "LWPOLYLINE"):
            return None
        out: list[dict[str, float | None]] = []
        for c, v in self.tags:
            if c == 10 or (c == 11 and self.type == "LINE"):
                out.append({"x": self.number(v), "y": None})
            elif c in (20, 21) and out:
                out[-1]["y"] = self.number(v)
        self.wrong |= any(p["y"] is None for p in out)
        return out

    def cells(self) -> list[str] | None:
        """Texts of a table's cells: between each start and end, the pieces of code 2 before the tail of code 1."""
        if self.type != "ACAD_TABLE":
            return None
        out: list[str] = []
        pieces: tuple[list[str], list[str]] | None = None
        for c, v in self.tags:
            if c == 301 and v == "CELL_VALUE":
                pieces = ([], [])
            elif c == 304 and v == "ACVALUE_END" and pieces is not None:
                out.append("".join(pieces[0] + pieces[1]).replace("^J", "\n"))
                pieces = None
            elif pieces is not None and c in (1, 2):
                pieces[0 if c == 2 else 1].append(v)
        self.wrong |= pieces is not None
        return out

    def value(self, column: str) -> object:
        of = self.type
        if column == "type":
            return of
        if column == "text":
            return self.text()
        if column == "vertices":
            return self.vertices()
        if column == "cells":
            return self.cells()
        if column == "closed":
            return bool((self.number(self.first(70), int) or 0) & 1) if of == "LWPOLYLINE" else None
        if column in ("x", "y"):
            return self.number(self.first(10 if column == "x" else 20))
        if column == "block":
            return self.first(2)
        if column in ("xscale", "yscale"):
            return self.number(self.first(41 if column == "xscale" else 42)) if of == "INSERT" else None
        if column in ("width_factor", "box_width"):
            return self.number(self.first(41)) if of == "MTEXT" and column == "box_width" or of in ("TEXT", "ATTRIB", "ATTDEF") and column == "width_factor" else None
        raw = self.first(CODES[column])
        return self.number(raw, int) if column == "flags" else self.number(raw) if column in ("height", "rotation") else raw


def _opened(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def _lines(f: pa.NativeFile, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Lines from at on, read in blocks no larger than what is left up to end; beyond it, where a last entity may go on, in small ones."""
    rest, to = b"", at
    while block := f.read(min(1 << 20, max(end - to, 1 << 13))):
        to += len(block)
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for p in parts:
            yield at, p
            at += len(p) + 1
    if rest:
        yield at, rest


def records(path: str, start: int, end: int) -> Iterator[Record]:
    """The entities that start in [start, end), whole."""
    held, name = _opened(path)
    with held.open_input_file(name) as f:
        f.seek(max(0, start - 1))
        lines = _lines(f, max(0, start - 1), end)
        if start:
            next(lines, None)  # the line that a split begins inside belongs to the one before
        offset, tags = -1, []
        zero: tuple[int, bytes] | None = None
        for at, line in lines:
            if zero is not None and NAME.match(line):
                if tags and offset >= 0:
                    yield Record(offset, tags)
                offset, tags = (zero[0], [zero[1], line]) if zero[0] < end else (-1, [])
                zero = None
                if offset < 0:
                    return
                continue
            if zero is not None and offset >= 0:
                tags.append(zero[1])
            zero = (at, line) if line.strip() == b"0" else None
            if zero is None and offset >= 0:
                tags.append(line)
        if zero is not None and offset >= 0:
            tags.append(zero[1])
        if tags and offset >= 0:
            yield Record(offset, tags)


class TagReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.options = schema, dict(options)
        wanted = [(k.partition(".")[2], set(json.loads(v))) for k, v in self.options.items() if k.startswith("only.")]
        self.wanted = sorted(wanted, key=lambda w: w[0] != "type")  # the type needs no parsing
        if unknown := {c for c, _ in self.wanted} - FILTERED:
            raise ValueError(f"reading cannot be confined by {sorted(unknown)}")

    def partitions(self) -> list[Split]:
        from pyarrow import fs

        path, size = self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES))
        held, name = _opened(path)
        info = held.get_file_info(name)
        found = held.get_file_info(fs.FileSelector(name, recursive=True)) if info.type == fs.FileType.Directory else [info]
        files = [x for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        # Each task has its price, so small splits of large inputs go to a task in runs of neighbours; entities start in one of them all the same.
        most = int(self.options.get("maxtasks", MAX_TASKS))
        total = sum(x.size for x in files)
        size *= max(1, min(-(-total // (size * most)), SPLIT_BYTES // size))
        scheme = path[: path.index(":") + 1] + "//" if re.match(r"[a-z][a-z0-9+.-]+:", path) else ""
        return [Split(f"{scheme}{x.path}", a, min(a + size, x.size)) for x in sorted(files, key=lambda x: x.path) for a in range(0, x.size, size)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        mode = self.options.get("mode", "PERMISSIVE").upper()
        arrow, names = to_arrow_schema(self.schema), self.schema.names
        rows: list[list] = []
        for r in records(partition.path, partition.start, partition.end):
            if any(r.value(c) not in allowed for c, allowed in self.wanted):
                continue
            _ = r.tags  # what is wrong with them counts, whichever columns are wanted
            values = {c: r.value(c) for c in names if c not in ("file", "ord", "_corrupt_record")}
            if r.wrong and mode == "FAILFAST":
                raise ValueError(f"malformed record at {partition.path}:{r.offset}")
            if r.wrong and mode == "DROPMALFORMED":
                continue
            values |= {"file": partition.path, "ord": r.offset, "_corrupt_record": b"\n".join(r.lines).decode(errors="replace") if r.wrong else None}
            rows.append([values[c] for c in names])
            if len(rows) == BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


class TagSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tags"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> TagReader:
        return TagReader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known to a session. The module travels with it, so workers need not find it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TagSource)


def read_tags(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, mode: str = "PERMISSIVE", schema: str | None = None, only: dict[str, list[str]] | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("tags").option("splitBytes", str(split_bytes)).option("mode", mode)
    for column, values in (only or {}).items():
        reader = reader.option(f"only.{column}", json.dumps(values))
    return (reader.schema(schema) if schema else reader).load(path)


# ---------------------------------------------------------------- drawings from and to tags


def error_count(found: DataFrame) -> DataFrame:
    """(file, records, errors): the audit of an open, a row a file."""
    return found.groupBy("file").agg(F.count("*").alias("records"), F.count("_corrupt_record").alias("errors"))


def entities(found: DataFrame) -> DataFrame:
    """Entities of drawings from what was read: spaces by their owners' records, attributes with their reference.

    The job is the number behind job_id= in the path. A record without owner stands in model space. bad says why an entity is not
    whole, for a tolerant scan.
    """
    found = checkpointed(found)  # the files are read and parsed once
    job = F.regexp_extract("file", r"job_id=(\d+)", 1).try_cast("long")
    rows = found.withColumn("job_id", F.coalesce(job, F.lit(0)))
    record = rows.where("type = 'BLOCK_RECORD'").select("job_id", F.col("handle").alias("owner"), F.col("block").alias("name"))
    name = F.col("name")
    space = F.when(name.isNull() | F.upper(name).rlike(r"^[*$]MODEL_SPACE"), "model").when(F.upper(name).rlike(r"^[*$]PAPER_SPACE"), F.concat(F.lit("paper:"), F.substr(name, F.lit(13)))).otherwise(F.concat(F.lit("block:"), name))
    attribs = rows.where("type = 'ATTRIB'").groupBy("job_id", F.col("owner").alias("handle")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("block").alias("tag"), "text"))), lambda a: F.struct(a["tag"].alias("tag"), a["text"].alias("text"))).alias("attribs"))
    body = rows.where("type not in ('BLOCK_RECORD', 'ATTRIB', 'SECTION', 'ENDSEC', 'EOF', 'SEQEND')")
    out = body.join(record, ["job_id", "owner"], "left").join(attribs, ["job_id", "handle"], "left")
    return out.select("job_id", space.alias("space"), "ord", "type", "handle", "layer", "style", "text", "flags", "height", "x", "y", "attribs", "cells", "vertices", "closed", "width_factor", "box_width", "rotation", F.when(F.col("type") == "INSERT", F.col("block")).alias("block"), "xscale", "yscale", F.when(F.col("_corrupt_record").isNotNull(), "malformed record").alias("bad"))


def _tag(code: int, value: Column) -> Column:
    """One tag as two lines; null: no tag."""
    return F.concat(F.lit(f"{code:>3}\n"), value.cast("string"))


def tag_text(e: DataFrame) -> Column:
    """An entity as its tags; e has the columns of entities()."""
    has = lambda c: F.col(c) if c in e.columns else F.lit(None).cast("string")
    safe = lambda c: F.replace(c, F.lit("\n"), F.lit("^J"))
    kind, none = F.col("type"), F.lit(None).cast("string")
    line = kind == "LINE"
    shape = kind.isin("LINE", "LWPOLYLINE")
    points = F.array_join(F.transform("vertices", lambda v, i: F.concat(F.when(line & (i == 1), _tag(11, v["x"])).otherwise(_tag(10, v["x"])), F.lit("\n"), F.when(line & (i == 1), _tag(21, v["y"])).otherwise(_tag(20, v["y"])))), "\n")
    cells = F.array_join(F.transform("cells", lambda c: F.concat(F.lit("301\nCELL_VALUE\n"), _tag(1, safe(c)), F.lit("\n304\nACVALUE_END"))), "\n")
    attribs = F.array_join(F.transform("attribs", lambda a, i: F.concat_ws("\n", F.lit("  0\nATTRIB"), _tag(5, F.concat(F.col("handle"), F.lit("."), i.cast("string"))), _tag(330, F.col("handle")), _tag(2, a["tag"]), _tag(1, safe(a["text"])))), "\n")
    fields = [
        _tag(0, kind), _tag(5, F.col("handle")), _tag(330, has("owner")), _tag(8, F.col("layer")), _tag(7, F.col("style")), F.when(kind == "INSERT", _tag(2, has("block"))),
        F.when(~shape, _tag(10, F.col("x"))), F.when(~shape, _tag(20, F.col("y"))), F.when(~shape, _tag(40, F.col("height"))), F.when(kind == "INSERT", _tag(41, has("xscale"))).when(kind == "MTEXT", _tag(41, has("box_width"))).when(kind.isin("TEXT", "ATTDEF"), _tag(41, has("width_factor"))),
        F.when(kind == "INSERT", _tag(42, has("yscale"))), F.when(~shape, _tag(50, has("rotation"))), _tag(70, F.when(kind == "LWPOLYLINE", F.col("closed").cast("int")).otherwise(F.col("flags"))), F.when(kind != "ACAD_TABLE", _tag(1, safe(F.col("text")))),
        F.when(shape, F.nullif(points, F.lit(""))), F.when(kind == "ACAD_TABLE", F.nullif(cells, F.lit(""))), F.when(kind == "INSERT", F.nullif(attribs, F.lit(""))),
    ]
    return F.concat_ws("\n", *(F.coalesce(f, none) for f in fields))


def write_tags(e: DataFrame, path: str) -> None:
    """Drawings as tag files, a folder job_id=… each, with a record for each of their spaces; entities keep their order (ord) inside a file.

    A space's record has the space as its handle. The parts of one job may be several files.
    """
    name = F.when(F.col("space") == "model", "*Model_Space").when(F.col("space").startswith("paper:"), F.concat(F.lit("*Paper_Space"), F.substr("space", F.lit(7)))).otherwise(F.regexp_replace("space", "^block:", ""))
    records_ = e.select("job_id", "space").distinct().select("job_id", F.lit(-1).cast("long").alias("ord"), F.concat_ws("\n", F.lit("  0\nBLOCK_RECORD"), _tag(5, F.col("space")), _tag(2, name)).alias("value"))
    rows = e.withColumn("owner", F.col("space"))
    body = rows.select("job_id", F.col("ord").cast("long").alias("ord"), tag_text(rows).alias("value"))
    records_.unionByName(body).repartition("job_id").sortWithinPartitions("job_id", "ord").select("job_id", "value").write.partitionBy("job_id").text(path)
