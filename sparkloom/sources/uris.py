"""Source and destination schemes."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

# Other names of a scheme.
ALIASES = {"postgresql": "postgres", "postgresql+psycopg2": "postgres", "postgresql+asyncpg": "postgres", "pg": "postgres", "redshift+psycopg2": "redshift", "azure-sql": "azuresql", "gs": "gcs", "ndjson": "jsonl", "md": "motherduck"}
# Schemes whose rest is a path.
FILES = {"csv": "csv", "parquet": "parquet", "json": "json", "jsonl": "json", "orc": "orc", "text": "text", "avro": "avro"}
# Schemes read through a JDBC driver on the class path.
JDBC = {"postgres": "postgresql", "mysql": "mysql", "mssql": "sqlserver", "oracle": "oracle", "db2": "db2", "redshift": "redshift", "snowflake": "snowflake", "sqlite": "sqlite", "duckdb": "duckdb", "clickhouse": "clickhouse", "databricks": "databricks"}
#: Schemes that need a connector package.
CONNECTORS = {"mongodb", "cassandra", "elasticsearch", "influxdb", "bigquery", "kafka", "kinesis", "iceberg"}
#: Schemes of object stores that Hadoop's own file systems serve.
STORES = {"s3": "s3a", "gcs": "gs", "adls": "abfss", "sftp": "sftp"}
# Schemes of hosted services and further stores that plans may name; each needs a connector of its own.
SERVICES = frozenset(
    """athena trino cratedb couchbase dynamodb spanner synapse fabric onelake maxcompute avatica azuresql hana motherduck sqlserver mmap
    abfs abfss azure stripe hubspot salesforce notion slack shopify github jira linear asana mixpanel mailchimp klaviyo facebook_ads
    google_ads tiktok_ads linkedin_ads anthropic adjust appsflyer intercom zendesk docebo fireflies gorgias clickup hostaway personio
    pinterest pipedrive posthog quickbooks smartsheet snapchat_ads surveymonkey trustpilot zoom chess cursor dune freshdesk fundraiseup
    g2 granola indeed isoc_pulse jobtread monday phantombuster plusvibeai primer revenuecat solidgate allium apple_ads applovin attio
    bruin customerio frankfurter appstore""".split()
)
#: A scheme by the URI standard: a letter, then letters, digits, plus, dot or hyphen; underscores are let through for service names.
SCHEME = re.compile(r"[A-Za-z](?:[A-Za-z0-9]|[+.\-]|_)*\Z")


def normalise(scheme: str) -> str:
    return ALIASES.get(scheme.lower(), scheme.lower())


def problems(uri: str) -> list[str]:
    """Why a URI is not usable; empty if it is."""
    if not uri:
        return ["empty"]
    scheme, sep, rest = uri.partition("://")
    if not sep:
        return ["no ://"]
    if not SCHEME.match(scheme):
        return ["bad scheme"]
    scheme = normalise(scheme)
    if scheme in FILES or scheme in ("sqlite", "duckdb"):
        return [] if rest else ["no path"]
    if scheme in SERVICES:
        return []
    if scheme in SOURCES:
        return [] if rest else ["no path"]
    if scheme not in JDBC and scheme not in CONNECTORS and scheme not in STORES:
        return [f"unsupported scheme {scheme}"]
    parts = urlsplit(f"x://{rest}")
    try:
        port = parts.port
    except ValueError:
        return ["bad port"]
    out = [] if parts.hostname else ["no host"]
    return out + (["bad port"] if port == 0 else [])


def read(spark: SparkSession, uri: str, **options) -> DataFrame:
    """A frame for a file, store or JDBC URI. `#format` after a path overrides its ending."""
    why = problems(uri)
    if why:
        raise ValueError(f"{uri}: {', '.join(why)}")
    scheme, _, rest = uri.partition("://")
    scheme = normalise(scheme)
    if scheme in FILES:
        path, _, hint = rest.partition("#")
        kind = FILES[normalise(hint)] if hint else FILES[scheme]
        if kind == "csv":
            options = {"header": True, "inferSchema": "schema" not in options} | options
        if scheme == "json":
            options = {"multiLine": True} | options
        schema = options.pop("schema", None)
        reader = spark.read.options(**options)
        return (reader.schema(schema) if schema else reader).format(kind).load(path)
    if scheme in STORES:
        path, _, hint = rest.partition("#")
        return spark.read.options(**options).format(FILES[normalise(hint or path.rsplit(".", 1)[-1])]).load(f"{STORES[scheme]}://{path}")
    if scheme in SOURCES:
        return SOURCES[scheme](spark, rest, **options)
    if scheme in JDBC:
        return spark.read.format("jdbc").options(**jdbc_options(uri, **options)).load()
    raise NotImplementedError(f"{scheme} needs its connector package on the class path")


def write(df: DataFrame, uri: str, mode: str = "errorifexists", partition_by=(), **options) -> None:
    scheme, _, path = uri.partition("://")
    kind = FILES.get(normalise(scheme))
    if normalise(scheme) in DESTINATIONS:
        DESTINATIONS[normalise(scheme)](df, path, mode=mode, **options)
        return
    if normalise(scheme) in JDBC:
        df.write.format("jdbc").mode(mode).options(**jdbc_options(uri, **options)).save()
        return
    if kind is None:
        raise NotImplementedError(f"{scheme} is not a file scheme")
    if kind == "csv":
        options = {"header": True} | options
    df.write.mode(mode).options(**options).partitionBy(*partition_by).format(kind).save(path)


def kind(scheme: str) -> str:
    """How a scheme is reached: file, jdbc, store, connector, or unknown."""
    scheme = normalise(scheme)
    for name, known in (("file", FILES), ("jdbc", JDBC), ("store", STORES), ("registered", SOURCES), ("connector", CONNECTORS | SERVICES)):
        if scheme in known:
            return name
    return "unknown"


#: Readers and writers by scheme, beside those above; modules add their own.
SOURCES: dict[str, Callable[..., DataFrame]] = {}
DESTINATIONS: dict[str, Callable[..., None]] = {}


def source(*schemes: str):
    """Register a reader (spark, rest, **options) -> DataFrame."""

    def put(f):
        SOURCES.update((normalise(x), f) for x in schemes)
        return f

    return put


def destination(*schemes: str):
    """Register a writer (df, rest, mode, **options)."""

    def put(f):
        DESTINATIONS.update((normalise(x), f) for x in schemes)
        return f

    return put


def jdbc_options(uri: str, table: str | None = None, parallelism: int | None = None, page_size: int | None = None, partition_column: str | None = None, bounds: tuple | None = None, **options) -> dict[str, str]:
    """Options of a JDBC read or write: user and password from the URI, a table, as many parallel ranges of a column, rows a fetch."""
    scheme, _, rest = uri.partition("://")
    parts = urlsplit(f"x://{rest}")
    place = (parts.hostname or "") + (f":{parts.port}" if parts.port else "") + parts.path
    out = {"url": f"jdbc:{JDBC[normalise(scheme)]}://{place}"} | {k: v for k, v in (("user", parts.username), ("password", parts.password), ("dbtable", table)) if v}
    if partition_column and bounds:
        out |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parallelism or 4)}
    if page_size:
        out["fetchsize"] = str(page_size)
    return out | {k: str(v) for k, v in options.items()}


@source("memory")
def _memory(spark: SparkSession, rest: str, **options) -> DataFrame:
    return spark.table(rest)


@destination("memory")
def _keep(df: DataFrame, rest: str, mode: str = "overwrite", **options) -> None:
    df.createOrReplaceTempView(rest)
