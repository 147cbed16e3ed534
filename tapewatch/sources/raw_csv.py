"""Exchange CSV files: ``base/YYYYMMDD/[YYYYMMDD/]<ticker>/<file>``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.functions.numbers import number
from tapewatch.functions.times import tick_time
from tapewatch.operators.asof import first_quotes
from tapewatch.operators.events import side_events, timed_orders
from tapewatch.operators.ordered import small_side
from tapewatch.session import staged
from tapewatch.schemas import (
    EVENT_STREAM_FILE,
    EVENT_STREAM_NAMES,
    ORDER_COLUMNS,
    ORDER_FILE,
    QUOTE_COLUMNS,
    QUOTE_FILE,
    QUOTE_VALUES,
    RAW_NAMES,
    TRADE_COLUMNS,
    TRADE_FILE,
)

DEFAULT_ENCODING = "gbk"
# A row has at least a date, a time and an id or price: no row is shorter than this many bytes.
SHORTEST_ROW = 20
FILE_POSITION = ("_split_start", "_row_number")
# Bytes of a file that are read to find its header; more only if its first line is longer.
HEAD_BYTES = 4096
# Fixed value: eight digits name a date folder.
DATE_GLOB = "[0-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9]"


def _options(spark: SparkSession, encoding: str):
    if encoding.lower() not in ("utf-8", "utf8"):
        # Java's own charsets cover the Chinese encodings
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.option("encoding", encoding)


def _existing(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Those of the path patterns that match a file (one lookup per pattern, not per file)."""
    jvm = spark._jvm
    found = []
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
            found.append(pattern)
    return found


def table_paths(
    spark: SparkSession, base: str, file_name: str, dates: Sequence[str] = (), tickers: Sequence[str] = ()
) -> list[str]:
    """Path patterns of one raw table, in both folder layouts; allow-lists prune the listing."""
    day = "{" + ",".join(dates) + "}" if dates else DATE_GLOB
    ticker = "{" + ",".join(tickers) + "}" if tickers else "*"
    root = base.rstrip("/")
    return _existing(spark, [f"{root}/{day}/{ticker}/{file_name}", f"{root}/{day}/{DATE_GLOB}/{ticker}/{file_name}"])


def _names(header: str | Column) -> Column:
    """Column names of a header line in order, without marks and quotes."""
    bare = F.regexp_replace(header, "[\ufeff\r]", "")
    return F.transform(F.split(bare, ","), lambda n: F.trim(F.regexp_replace(F.trim(n), '^"|"$', "")))


def head_reader(encoding: str) -> Callable[[str], tuple[str | None, int]]:
    """Reads the first line of a file that is not blank, and tells the bytes it took: ``HEAD_BYTES``, and more only for a longer line."""
    block_size = HEAD_BYTES

    def first_line(uri: str) -> tuple[str | None, int]:
        # needs nothing of this package in the workers
        from urllib.parse import quote

        from pyarrow import fs

        # Spark's paths escape what is no letter of any script; the others are escaped here
        store, path = fs.FileSystem.from_uri(quote(uri.replace("s3a://", "s3://", 1), safe="%/:@!$&'()*+,;=~"))
        seen, found = b"", None
        with store.open_input_file(path) as file:
            while found is None and (block := file.read(block_size)):
                seen += block
                # what ends in a line end is whole; a line end is never part of another character in these encodings
                found = next((line for line in seen.split(b"\n")[:-1] if line.strip()), None)
        if found is None and seen.strip():
            found = seen.lstrip(b"\r\n").split(b"\n")[-1]
        return None if found is None else found.decode(encoding, errors="replace"), len(seen)

    return first_line


def file_heads(spark: SparkSession, paths: Sequence[str], encoding: str) -> DataFrame:
    """``path``, first ``line`` and ``bytes`` read of every file. The list comes from metadata; tasks read file heads only."""
    # one file or many to a task, whatever their sizes: a head costs the same
    files = spark.read.format("binaryFile").load(list(paths)).select(F.col("_metadata.file_path").alias("path"))
    dealt = files.repartition(F.xxhash64("path"))
    first_line = head_reader(encoding)

    def heads(batches):
        import pyarrow as pa

        for batch in batches:
            found = [first_line(uri) for uri in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), pa.array([line for line, _ in found], pa.string()), pa.array([size for _, size in found], pa.int64())], ["path", "line", "bytes"]
            )

    return dealt.mapInArrow(heads, "path string, line string, bytes long")


def header_layouts(spark: SparkSession, paths: Sequence[str], encoding: str, marker: str) -> DataFrame:
    """Column names of every file: (path, header). ``marker`` is a column name every header contains; the
    header of a file without it is null."""
    names = _names(F.col("line"))
    heads = file_heads(spark, paths, encoding).where(F.col("line").isNotNull())
    return heads.select("path", F.when(F.array_contains(names, F.lit(marker)), names).alias("header"))


def _place(path: Column) -> dict[str, Column]:
    return {
        "trade_date": F.regexp_extract(path, "/([0-9]{8})/", 1),
        "ticker": F.url_decode(F.regexp_extract(path, "/([^/]+)/[^/]+$", 1)),
    }


def read_named(
    spark: SparkSession,
    paths: Sequence[str],
    columns: Sequence[str],
    encoding: str = DEFAULT_ENCODING,
    names: dict[str, str] = RAW_NAMES,
    mixed_headers: bool = True,
    placed: bool = True,
    positions: bool = False,
) -> DataFrame:
    """All files as text columns selected by name; if ``placed``, with trade date and ticker from the path.

    Spark applies one header to all files of a read, so files are read by position. With ``mixed_headers``
    the head of every file is read first. The header that most files share gives the positions; only files with another one are named in a
    table, which is joined by path. Where all files agree nothing is joined and only the wanted columns are
    parsed. A file whose header names none of the columns gives no rows. Without ``mixed_headers`` one file's header is trusted, and a file
    with another one makes the read fail. Of a name that a header repeats the first column counts.
    Columns a file lacks are null. ``positions`` adds columns that order the rows of a file.
    """
    marker = next(source for source, name in names.items() if name in columns)
    sources = {c: [source for source, name in names.items() if name == c] + [c] for c in columns}

    def reader(fields: Sequence[str], trusted: bool) -> DataFrame:
        schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
        # a header that repeats a name cannot be compared with a schema
        loose = not trusted or len(set(fields)) < len(fields)
        fields_once = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(fields))]) if loose else schema
        return _options(spark, encoding).option("header", True).option("enforceSchema", loose).schema(fields_once).csv(list(paths))

    place = [F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    extra = [c.alias(n) for c, n in zip(place, FILE_POSITION)] if positions else []
    path = F.col("_metadata.file_path").alias("_path")

    def place_in(header: Sequence[str], column: str) -> int | None:
        return next((header.index(s) for s in sources[column] if s in header), None)

    if mixed_headers:
        layouts = staged(header_layouts(spark, paths, encoding, marker))
        # as many rows as there are different headers
        usual = layouts.groupBy("header").count().orderBy(F.col("header").isNull(), F.desc("count"), F.concat_ws(",", "header")).first()
        common = list(usual["header"] or []) if usual else []
        others = layouts.where(~F.col("header").eqNullSafe(F.lit(common) if common else F.lit(None).cast("array<string>")))
        width = max(len(common), others.agg(F.max(F.size("header"))).first()[0] or 0, 1)
        frame = reader([f"_c{i}" for i in range(width)], trusted=False)
        fixed = {c: place_in(common, c) for c in columns}
        cells = {c: F.lit(None).cast("string") if fixed[c] is None else F.col(f"_c{fixed[c]}") for c in columns}
        if others.isEmpty():
            frame = frame.select(*[cells[c].alias(c) for c in columns], *extra, path)
        else:
            rows = frame.select(F.array(*[F.col(f"_c{i}") for i in range(width)]).alias("_cells"), *[cells[c].alias(c) for c in columns], *extra, path)
            named = others.select(F.col("path").alias("_path"), "header", F.lit(True).alias("_other"))
            found = rows.join(small_side(named), "_path", "left").where(F.col("_other").isNull() | F.col("header").isNotNull())
            own = {c: F.coalesce(*[F.nullif(F.array_position("header", s), F.lit(0)) for s in sources[c]]) for c in columns}
            picked = [F.when(F.col("_other"), F.get("_cells", (own[c] - 1).cast("int"))).otherwise(F.col(c)).alias(c) for c in columns]
            frame = found.select(*picked, *[n for n in FILE_POSITION if positions], "_path")
    else:
        heads = file_heads(spark, paths[:1], encoding).select(_names(F.col("line")).alias("header"))
        first = heads.where(F.array_contains("header", F.lit(marker))).first()
        fields = list(first["header"]) if first else []
        frame = reader(fields, trusted=True)
        places = {c: place_in(fields, c) for c in columns}
        picked = [(F.lit(None).cast("string") if places[c] is None else F.col(f"`{frame.columns[places[c]]}`")).alias(c) for c in columns]
        frame = frame.select(*picked, *extra, path)
    return (frame.withColumns(_place(F.col("_path"))) if placed else frame).drop("_path")


def read_raw_orders(
    spark: SparkSession, base: str, encoding: str = DEFAULT_ENCODING, mixed_headers: bool = True, **where
) -> DataFrame:
    paths = table_paths(spark, base, ORDER_FILE, **where)
    return read_named(spark, paths, ORDER_COLUMNS, encoding, mixed_headers=mixed_headers)


def read_raw_trades(
    spark: SparkSession, base: str, encoding: str = DEFAULT_ENCODING, mixed_headers: bool = True, **where
) -> DataFrame:
    paths = table_paths(spark, base, TRADE_FILE, **where)
    return read_named(spark, paths, TRADE_COLUMNS, encoding, mixed_headers=mixed_headers)


def read_raw_quotes(
    spark: SparkSession, base: str, encoding: str = DEFAULT_ENCODING, mixed_headers: bool = True, **where
) -> DataFrame:
    """Quotes need seven of the file's columns; the others are not parsed. No file, no rows."""
    paths = table_paths(spark, base, QUOTE_FILE, **where)
    if not paths:
        names = [*QUOTE_COLUMNS, *FILE_POSITION, "trade_date", "ticker"]
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in names]))
    return read_named(spark, paths, QUOTE_COLUMNS, encoding, mixed_headers=mixed_headers, positions=True)


def typed_quotes(raw: DataFrame) -> DataFrame:
    return raw.select(
        "trade_date",
        "ticker",
        tick_time(F.col("date"), F.col("time")).alias("quote_ts"),
        *[number(F.col(c)).alias(c) for c in QUOTE_VALUES],
        *[c for c in FILE_POSITION if c in raw.columns],
    )


def read_ticks(
    spark: SparkSession,
    base: str,
    order_encoding: str = DEFAULT_ENCODING,
    quote_encoding: str = DEFAULT_ENCODING,
    dates: Sequence[str] = (),
    tickers: Sequence[str] = (),
    mixed_headers: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Typed orders, side events and one quote per instant."""
    where = {"dates": list(dates), "tickers": list(tickers), "mixed_headers": mixed_headers}
    orders = timed_orders(read_raw_orders(spark, base, order_encoding, **where))
    events = side_events(read_raw_trades(spark, base, order_encoding, **where))
    quotes = first_quotes(typed_quotes(read_raw_quotes(spark, base, quote_encoding, **where)), order=FILE_POSITION)
    return orders, events, quotes


def available_days(spark: SparkSession, base: str, file_name: str = ORDER_FILE, **where) -> DataFrame:
    """Ticker-days that have a file, from file metadata alone."""
    paths = table_paths(spark, base, file_name, **where)
    files = spark.read.format("binaryFile").load(paths).select("path")
    return files.select(*[c.alias(n) for n, c in _place(F.col("path")).items()]).distinct()


def row_bounds(spark: SparkSession, base: str, **where) -> DataFrame:
    """Upper bound of order and quote rows per ticker-day, from file sizes alone."""
    paths = [p for name in (ORDER_FILE, QUOTE_FILE) for p in table_paths(spark, base, name, **where)]
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    placed = files.withColumns(_place(F.col("path")))
    return placed.select("trade_date", "ticker", F.ceil(F.col("length") / SHORTEST_ROW).alias("rows_at_most"))


def read_event_stream_csv(
    spark: SparkSession, root: str, dates: Sequence[str] = (), encoding: str = "utf-8"
) -> DataFrame:
    """An exported event stream, ``root/YYYYMMDD/<file>``, as text columns under the names used here."""
    day = "{" + ",".join(dates) + "}" if dates else DATE_GLOB
    paths = _existing(spark, [f"{root.rstrip('/')}/{day}/{EVENT_STREAM_FILE}"])
    columns = list(dict.fromkeys(EVENT_STREAM_NAMES.values()))
    return read_named(spark, paths, columns, encoding, EVENT_STREAM_NAMES, placed=False)
