"""A Spark data source for interned table text: a compact form in which tools return rows.

    #MUNCH/1 tool=list enc=utf8
    @6=src/
    @66=src/main/
    count=2 __stypes=count:int __tables=t:repos:repo|symbols|loadable:str|int|bool
    t,@66App,12,T
    t,"a,b",3,F

`@n=` lines name texts, which may themselves hold earlier ones; wherever a value holds @n the longest
known number is put in its place. A line of name=value pairs gives scalars, their kinds and the tables
(tag:name:columns:kinds, parted by semicolons); a line that begins with a tag is a row of its table,
with values quoted where needed. Rows come out as (table, row, column, value, kind), scalars under
the table "", so that files with different tables fit one schema; `typed()` gives one table its own columns.
Text that doesn't begin with the head has no rows, and lines that fit nothing are passed over.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = {"int": "long", "long": "long", "float": "double", "double": "double", "bool": "boolean", "str": "string", "string": "string"}
_PAIR = r"""(\w+)=("[^"]*"|'[^']*'|[^\s]*)"""


def expanded(value: str, known: dict[str, str]) -> str:
    """value with the longest known number after each @ replaced by its text."""

    def put(m: re.Match) -> str:
        size = next((n for n in range(len(m[1]), 0, -1) if m[1][:n] in known), 0)
        return known[m[1][:size]] + m[1][size:] if size else m[0]

    return re.sub(r"@(\d+)", put, value)


def pairs_of(text: str) -> dict[str, str]:
    return {k: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v for k, v in re.findall(_PAIR, text)}


def rows_of(text: str):
    """(table, row, column, value, kind) of each cell; an empty value has no cell."""
    lines = re.split(r"\r?\n", text.strip())
    if not lines[0].startswith("#MUNCH/"):
        return
    known: dict[str, str] = {}
    tables: dict[str, tuple[str, list[str], list[str]]] = {}
    count: dict[str, int] = {}
    for line in map(str.strip, lines[1:]):
        if m := re.match(r"^@(\d+)=(.*)$", line):
            known[m[1]] = expanded(m[2], known)
        elif "__tables=" in line or "__stypes=" in line or re.match(r"^\w+=[^,]*$", line):
            found = pairs_of(line)
            for group in found.pop("__tables", "").split(";"):
                tag, name, columns, kinds = (group.split(":") + [""] * 4)[:4]
                if tag.strip() and columns:
                    tables[tag.strip()] = (name.strip(), columns.split("|"), kinds.split("|"))
            kind = dict(p.split(":") for p in found.pop("__stypes", "").split(",") if p.count(":") == 1)
            for k, v in found.items():
                yield "", 0, k, v, kind.get(k, "str")
        elif line.partition(",")[0] in tables and "," in line:
            tag, _, rest = line.partition(",")
            name, columns, kinds = tables[tag]
            n = count[tag] = count.get(tag, -1) + 1
            for k, (column, cell) in enumerate(zip(columns, next(csv.reader(io.StringIO(rest))), strict=False)):
                if cell:
                    yield name, n, column.strip(), expanded(cell, known), kinds[k].strip() if k < len(kinds) else "str"


def attributes(text: Column) -> Column:
    """map<string,string> of name=value pairs; quotes around a value go, the last of equal names counts."""
    names, found = F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1)), F.regexp_extract_all(text, F.lit(_PAIR), F.lit(2))
    bare = F.transform(found, lambda v: F.when(v.rlike("""^(".*"|'.*')$"""), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v))
    both = F.arrays_zip(names.alias("k"), bare.alias("v"))
    last = F.filter(both, lambda x, i: ~F.exists(F.slice(names, i + 2, F.size(names)), lambda n: n == x["k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def python_counts(text: Column) -> Column:
    """map<string,long> of what a Python dictionary of counts says; null for what is none."""
    form = F.lit(r"'([^']+)'\s*:\s*(\d+)")
    names = F.regexp_extract_all(text, form, F.lit(1))
    counts = F.transform(F.regexp_extract_all(text, form, F.lit(2)), lambda x: x.cast("long"))
    both = F.arrays_zip(names.alias("k"), counts.alias("v"))
    last = F.filter(both, lambda x, i: ~F.exists(F.slice(names, i + 2, F.size(names)), lambda n: n == x["k"]))
    return F.when(F.size(names) > 0, F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"]))))


#: Cells of a file, or of a text in a column.
CELLS = "table string, row int, column string, value string, kind string"
#: Files that one task reads.
FILES_A_TASK = 64


class _Files(InputPartition):
    """Some of the files, in order of their paths."""


#: Columns on which a reader of a folder may be asked for one value, or (file alone) for a prefix.
ASKED = ("file", "table", "row", "column", "file_prefix")


class _Reader(DataSourceReader):
    """Lists a folder once, on the driver, and reads its files by ranges. What is asked of a file leaves out whole files, what is asked of the others cells.

    Filters come as options of the relation, not by pushFilters: readers that it is called for are kept with the
    relation, so that a plan that scans one relation twice, under different filters, would read with the last ones.
    """

    def __init__(self, options):
        self.text, self.path = options.get("text"), options.get("path")
        self.each = int(options.get("filesPerTask", FILES_A_TASK))
        self.asked = {c: options[c] for c in ASKED if options.get(c) is not None}

    def _fits(self, name: str, value) -> bool:
        return str(value) == self.asked.get(name, str(value))

    def _opens(self, file: str) -> bool:
        return self._fits("file", file) and file.startswith(self.asked.get("file_prefix", ""))

    def partitions(self):
        if self.path is None:
            return [_Files([])]
        system, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")) and self._opens(f.path))
        return [_Files(files[k : k + self.each]) for k in range(0, len(files), self.each)] or [_Files([])]

    def read(self, partition):
        texts = [("", self.text)] if self.path is None and self.text is not None and self._opens("") else []
        system = pafs.FileSystem.from_uri(self.path)[0] if self.path and "://" in self.path else pafs.LocalFileSystem()
        for file, text in chain(texts, ((f, None) for f in partition.value)):
            if text is None:
                with system.open_input_stream(file) as stream:
                    text = stream.read().decode("utf-8", "replace")
            for cell in rows_of(text):
                if self._fits("table", cell[0]) and self._fits("row", cell[1]) and self._fits("column", cell[2]):
                    yield (*cell, file)


class TableText(DataSource):
    """spark.dataSource.register(TableText); spark.read.format("table_text").load(folder), or .option("text", ...).load().

    A folder is read by FILES_A_TASK files a task (option filesPerTask); the options of ASKED leave out files and cells.
    """

    @classmethod
    def name(cls):
        return "table_text"

    def schema(self):
        return CELLS + ", file string"

    def reader(self, schema):
        return _Reader(self.options)


def folder(spark: SparkSession, path: str, files_a_task: int = FILES_A_TASK, **asked: object) -> DataFrame:
    """Cells of the files of a folder, with their file, read by ranges of files; asked names columns of ASKED and what they have to be.

    The source looks at it: a file that isn't asked for is not opened.
    """
    spark.dataSource.register(TableText)
    if left := set(asked) - set(ASKED):
        raise ValueError(f"can't be asked for: {sorted(left)}")
    return spark.read.format(TableText.name()).options(filesPerTask=files_a_task, **asked).load(path)


def from_column(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, cells): the cells of texts that are in a column; a text without the head (or null) has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *cell) for k, t in enumerate(batch.column(len(key)).to_pylist()) if t for cell in rows_of(t)]
            at = pa.array([x[0] for x in found], pa.int64())
            cells = [pa.array([x[n + 1] for x in found], kind) for n, kind in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))]
            yield pa.record_batch([*[batch.column(k).take(at) for k in range(len(key))], *cells], names=[*key, "table", "row", "column", "value", "kind"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    return rows.select(*key, text).mapInArrow(run, f"{fields}, {CELLS}")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all files under path, with their file, by whatever file system Spark reads."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return from_column(files, ["file"], "value")


def typed(cells: DataFrame, table: str, columns: dict[str, str], key: list[str] = ("row",)) -> DataFrame:
    """One table as columns; a value that isn't of its kind becomes null."""
    rows = cells.filter(F.col("table") == table)
    made = [F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    got = rows.groupBy(*key).agg(*made)
    flag = lambda c: F.when(F.col(c).isNotNull(), F.col(c).isin("T", "true", "1")).alias(c)
    return got.select(*key, *[flag(c) if k == "bool" else F.expr(f"try_cast({c} as {_KINDS[k]})").alias(c) for c, k in columns.items()])
