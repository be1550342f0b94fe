"""Copy options, result sinks and file metadata."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

#: COPY options and Spark's names for them.
CSV = {"HEADER": "header", "DELIMITER": "sep", "DELIM": "sep", "QUOTE": "quote", "ESCAPE": "escape", "NULL": "nullValue", "NULLSTR": "nullValue", "AUTO_DETECT": "inferSchema", "COMPRESSION": "compression", "DATEFORMAT": "dateFormat", "TIMESTAMPFORMAT": "timestampFormat"}


def csv_options(options: dict) -> dict:
    """Spark's options for COPY's, names in any case; SKIP, SAMPLE_SIZE, COLUMNS and FORCE_NOT_NULL are dealt with by `read_csv`."""
    out = {}
    for k, v in options.items():
        k = k.upper()
        if k in CSV:
            out[CSV[k]] = str(v).lower() if isinstance(v, bool) else v
        elif k not in ("SKIP", "SAMPLE_SIZE", "COLUMNS", "FORCE_NOT_NULL"):
            raise ValueError(f"unknown COPY option {k}")
    return out


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV file by COPY's options: columns as {name: type}, FORCE_NOT_NULL columns get '' for null, SKIP lines go first.

    With SKIP each file is read as one text and loses as many lines, so it
    must fit a task.
    """
    given = {k.upper(): v for k, v in options.items()}
    opts = {"header": "true", "inferSchema": "true"} | csv_options(given)
    schema = ", ".join(f"`{n}` {t}" for n, t in given["COLUMNS"].items()) if given.get("COLUMNS") else None
    if given.get("SAMPLE_SIZE"):
        n = spark.read.text(path).count()
        opts["samplingRatio"] = min(1.0, max(1e-6, int(given["SAMPLE_SIZE"]) / max(1, n)))
    if schema:
        opts["inferSchema"] = "false"
    reader = spark.read.options(**opts)
    source = path
    if given.get("SKIP"):
        source = scratch(spark, "skipped")
        whole = spark.read.text(path, wholetext=True)
        whole.select(F.array_join(F.expr(f"slice(split(value, '\\n'), {int(given['SKIP']) + 1}, greatest(size(split(value, '\\n')) - {int(given['SKIP'])}, 0))"), "\n").alias("value")).write.text(source)
    out = (reader.schema(schema) if schema else reader).csv(source)
    for c in given.get("FORCE_NOT_NULL", ()):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    return out


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    df.write.mode(mode).options(**{"header": "true"} | csv_options(options)).csv(path)


def bulk_out(df: DataFrame, path: str, field: str = "\t", row: str = "\n") -> None:
    """Rows in character mode: no header, no quotes, nulls as nothing, empty texts as a zero byte. A text that holds a terminator is an error, as it could not be read back."""
    clash = F.lit("a value holds a terminator")

    def cell(name: str):
        text = F.col(f"`{name}`").cast("string")
        return F.when(text.contains(field) | text.contains(row), F.raise_error(clash)).when(text == "", "\0").otherwise(F.coalesce(text, F.lit("")))

    df.select(F.concat_ws(field, *(cell(c) for c in df.columns)).alias("value")).write.option("lineSep", row).text(path)


def bulk_in(spark: SparkSession, path: str, schema: str, field: str = "\t", row: str = "\n") -> DataFrame:
    """What `bulk_out` wrote, in the table's types. Rows with another number of fields are an error."""
    from pyspark.sql.types import StructType

    columns = StructType.fromDDL(schema).fields
    parts = F.split("value", "\\Q" + field + "\\E", -1)
    whole = F.when(F.size(parts) == len(columns), parts).otherwise(F.raise_error(F.lit("wrong number of fields")))
    cells = spark.read.option("lineSep", row).text(path).select(whole.alias("f"))
    return cells.select(*(F.when(F.col("f")[i] == "\0", "").when(F.col("f")[i] != "", F.col("f")[i]).cast(c.dataType).alias(c.name) for i, c in enumerate(columns)))


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", row_group_bytes: int | None = None, records_per_file: int | None = None, partition_by=(), cluster_by=(), mode: str = "errorifexists") -> None:
    """Parquet with a codec, rows sorted inside files by the cluster columns, and bounds on files."""
    out = df.sortWithinPartitions(*cluster_by) if cluster_by else df
    w = out.write.mode(mode).option("compression", codec).partitionBy(*partition_by)
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    if records_per_file:
        w = w.option("maxRecordsPerFile", records_per_file)
    w.parquet(path)


def write_json(df: DataFrame, path: str, array: bool = False) -> None:
    """One object a line, or, with `array`, one array in each file: a file's rows are joined as they stream by, never gathered."""
    if not array:
        df.write.json(path)
        return
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))

    def bracket(batches):
        import pyarrow as pa

        last, first = None, True
        for b in batches:
            rows = b.column(0).to_pylist()
            if not rows:
                continue
            if last is not None:
                yield pa.RecordBatch.from_pydict({"value": [("[" if first else "") + last + ","]})
                first = False
            body = [r + "," for r in rows[:-1]]
            if body and first:
                body[0], first = "[" + body[0], False
            if body:
                yield pa.RecordBatch.from_pydict({"value": body})
            last = rows[-1]
        yield pa.RecordBatch.from_pydict({"value": [("[" if first else "") + (last or "") + "]"]})

    lines.mapInArrow(bracket, "value string").write.text(path)


def copy_query(spark: SparkSession, sql: str, path: str, fmt: str = "parquet", **tables: DataFrame) -> None:
    """COPY (query) TO: tables are the query's by name."""
    {"csv": write_csv, "parquet": write_parquet, "json": write_json}[fmt](spark.sql(sql, **tables), path)


def with_metadata(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Rows with the name, size and time of their file."""
    df = spark.read.format(fmt).load(path)
    return df.select("*", *(F.col(f"_metadata.{c}").alias(c) for c in ("file_name", "file_size", "file_modification_time")))


def batches(df: DataFrame, rows: int = 10_000) -> Iterator[list]:
    """The result in lists of rows, partition by partition: the driver holds one partition at a time."""
    held = []
    for r in df.toLocalIterator():
        held.append(r)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held


def sinks(df: DataFrame) -> dict:
    """A small result in the forms that callers ask for: list of tuples, one row, one column, pandas, Arrow. For results that fit the driver."""
    table = df.toArrow()
    rows = [tuple(r.values()) for r in table.to_pylist()]
    return {"all": rows, "one": rows[0] if rows else None, "column": [r[0] for r in rows], "pandas": table.to_pandas(), "arrow": table}
