"""CSV parts ordered by a whole-number key, read through a source that takes the filter.

write() lays a table out in ranges of its key, one file a range, sorted inside, and an index beside them: for every stretch
of about BLOCK bytes its file, offsets, and first and last key. The source `keyed_csv` hears of filters on the key before it
plans: only stretches whose keys can match become partitions (neighbours in a file together), and a task reads its bytes
only. Spark still tests every row, so the filter's result never depends on the index. Stretches end between rows, also where
a quoted value holds line breaks.

Files are opened through pyarrow's file systems, local or by URI. Null keys come first in their file and belong to stretches
without a first key, which every plan without a filter reads and every filter on the key skips. An empty table has no
stretches and no partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
import pyarrow.dataset
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK, NAME = 1 << 20, "keyed_csv"
INDEX = "file string, start long, stop long, first long, last long, n long"
_COLUMNS = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("start", "stop", "first", "last", "n"))])
_FORMAT = {"header": "false", "escape": '"', "nullValue": "", "emptyValue": '""', "dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}


def _opened(path: str):
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))
    return fs, at


def stretches(path: str, at: int, block: int = BLOCK):
    """(start, stop, first, last, n) of a file whose key is the field number `at` (no field before it may hold a comma or a quote)."""
    fs, name = _opened(path)
    start = end = n = 0
    first = last = None
    held = b""
    with fs.open_input_stream(name) as stream:
        while data := stream.read(1 << 20):
            lines = (held + data).split(b"\n")
            held = lines.pop()
            row = b""
            for i, line in enumerate(lines):
                row += line + b"\n"
                if row.count(b'"') % 2:
                    continue  # a line break inside quotes
                key = row.split(b",", at + 1)[at].strip()
                key = int(key) if key else None
                if n and (end - start >= block or (first is None) != (key is None)):
                    yield start, end, first, last, n
                    start, first, n = end, None, 0
                first, last, end, n, row = key if n == 0 else first, key, end + len(row), n + 1, b""
            held = row + held
    if n:
        yield start, end, first, last, n


def write(df: DataFrame, path: str, key: str, block: int = BLOCK) -> None:
    """df below path, the key as first column; the index is made by tasks, one file each, from the bytes as they lie there."""
    spark = df.sparkSession
    df.select(key, *(c for c in df.columns if c != key)).repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").options(**_FORMAT).csv(f"{path}/rows")
    files = spark.read.format("binaryFile").load(f"{path}/rows").select("path").where("path like '%.csv'")

    def index(batches):
        for b in batches:
            for p in b["path"].to_pylist():
                rows = [(p, *s) for s in stretches(p, 0, block)]
                yield pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(_COLUMNS.names)}, schema=_COLUMNS)

    files.mapInArrow(index, INDEX).orderBy("first").write.mode("overwrite").parquet(f"{path}/index")


@dataclass
class Stretch(InputPartition):
    file: str
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, key: str):
        self.schema, self.path, self.key, self.spans = schema, path, key, []

    def pushFilters(self, filters):
        """Keeps what bounds the key; every filter is handed back, as stretches hold other keys too."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.key,):
                if isinstance(f, EqualTo):
                    self.spans.append([(f.value, f.value)])
                elif isinstance(f, In):
                    self.spans.append([(v, v) for v in sorted(v for v in f.value if v is not None)])
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.spans.append([(f.value, None)])
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.spans.append([(None, f.value)])
                elif isinstance(f, IsNotNull):
                    self.spans.append([(None, None)])
            yield f

    def partitions(self):
        field = pyarrow.dataset.field
        fs, at = _opened(f"{self.path}/index")
        rule = None
        for spans in self.spans:
            low, high = min((a for a, _ in spans if a is not None), default=None), max((b for _, b in spans if b is not None), default=None)
            own = field("first").is_valid()
            own = own if low is None or any(a is None for a, _ in spans) else own & (field("last") >= low)
            own = own if high is None or any(b is None for _, b in spans) else own & (field("first") <= high)
            rule = own if rule is None else rule & own
        found = pyarrow.dataset.dataset(at, filesystem=fs, format="parquet", exclude_invalid_files=True).to_table(filter=rule).to_pylist()
        met = lambda r, spans: not spans or any((a is None or r["last"] >= a) and (b is None or r["first"] <= b) for a, b in spans)
        rows = sorted(((r["file"], r["start"], r["stop"]) for r in found if all(met(r, s) for s in self.spans)))
        out: list[Stretch] = []
        for file, start, stop in rows:
            if out and out[-1].file == file and out[-1].stop == start and stop - out[-1].start <= 64 * BLOCK:
                out[-1].stop = stop
            else:
                out.append(Stretch(file, start, stop))
        return out or [Stretch("", 0, 0)]

    def read(self, part: Stretch):
        schema = to_arrow_schema(self.schema)
        if not part.file:
            return
        fs, name = _opened(part.file)
        with fs.open_input_file(name) as f:
            f.seek(part.start)
            data = f.read(part.stop - part.start)
        types = {n: t if not pa.types.is_timestamp(t) else pa.timestamp("us") for n, t in zip(schema.names, schema.types)}
        table = pyarrow.csv.read_csv(
            pa.BufferReader(data), read_options=pyarrow.csv.ReadOptions(column_names=schema.names), parse_options=pyarrow.csv.ParseOptions(newlines_in_values=True, double_quote=True),
            convert_options=pyarrow.csv.ConvertOptions(column_types=types, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""]),
        )
        yield from table.cast(schema).to_batches(max_chunksize=8192)


class KeyedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options["path"], self.options["key"])


def read(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The table below path. schema names its columns in the order of the files (the key first)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeyedCsv)
    return spark.read.format(NAME).schema(schema).option("path", path).option("key", key).load()


def lookup(spark: SparkSession, path: str, schema: str, key: str, ids: list[int], order: list[str]) -> DataFrame:
    """Rows of some keys, in order; an absent key raises KeyError."""
    rows = read(spark, path, schema, key).where(F.col(key).isin(ids))
    absent = set(ids) - {r[0] for r in rows.select(key).distinct().collect()}  # at most the ids asked for
    if absent:
        raise KeyError(sorted(absent))
    return rows.orderBy(key, *order)
