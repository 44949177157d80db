"""Publishing of tables that readers see whole or not at all, and facts from file footers.

A table folder holds versions and manifests::

    <path>/data/<version>/part-*.parquet      written first, read by nobody
    <path>/manifest/00000003.json             one per published version, in order

``stage`` writes a version and counts it while it is written. ``publish`` checks
it and then creates the next manifest, which must not exist: of two writers that
start from the same one only the first gets it, the other is refused and its
files are removed. Readers follow the last manifest, so a crash before it leaves
the former version in place, and its leftovers are never read.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any, Callable, Mapping, NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.columns import count_if
from shelfcast.operators.contracts import ContractError
from shelfcast.session import drop_written


#: How long a writer may take between its two last steps.
LEASE_SECONDS = 600


class PublishConflict(RuntimeError):
    """Another writer published first."""


class Staged(NamedTuple):
    path: str
    version: str
    #: The manifest that this version is to follow (0: none).
    follows: int
    rows: int
    violations: dict[str, int]
    schema: str


def _fs(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _last(spark: SparkSession, path: str) -> int:
    fs, folder = _fs(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n[:8]) for n in names if n.endswith(".json") and n[:8].isdigit()), default=0)


def _manifest(path: str, number: int) -> str:
    return f"{path}/manifest/{number:08d}.json"


def manifest(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """What the last publication says of itself; None where nothing was published."""
    number = _last(spark, path)
    if not number:
        return None
    fs, file = _fs(spark, _manifest(path, number))
    stream = fs.open(file)
    try:
        body = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {"number": number, **json.loads(body)}


def stage(df: DataFrame, path: str, rules: Mapping[str, Column] | None = None) -> Staged:
    """Write a version that nobody reads yet; its rows and violations of ``rules`` are counted on the way."""
    spark, version, watch = df.sparkSession, uuid.uuid4().hex[:16], Observation()
    follows = _last(spark, path)
    counts = [count_if(bad).alias(name) for name, bad in (rules or {}).items()]
    df.observe(watch, F.count(F.lit(1)).alias("_rows"), *counts).write.parquet(f"{path}/data/{version}")
    seen = watch.get
    found = {name: int(seen[name] or 0) for name in rules or {}}
    return Staged(path, version, follows, int(seen["_rows"]), found, df.schema.json())


def publish(
    spark: SparkSession, staged: Staged, expected_rows: int | None = None, check: Callable[[DataFrame], None] | None = None
) -> int:
    """Make a staged version the one that is read; returns the number of its manifest.

    It is refused, and its files removed, if a rule is broken, if it has not ``expected_rows``, if ``check``
    raises on the version as read back, or if another version was published since it was staged.
    """
    data = f"{staged.path}/data/{staged.version}"
    try:
        broken = [f"{rule}={n}" for rule, n in sorted(staged.violations.items()) if n]
        if broken:
            raise ContractError(f"{staged.path} is not published: {', '.join(broken)}")
        if expected_rows is not None and staged.rows != expected_rows:
            raise ContractError(f"{staged.path} is not published: {staged.rows} rows, {expected_rows} expected")
        if check is not None:
            check(_read_version(spark, staged.path, staged.version, staged.schema))
        about = {"version": staged.version, "rows": staged.rows, "schema": staged.schema}
        _create(spark, _manifest(staged.path, staged.follows + 1), json.dumps(about))
    except Exception:
        drop_written(spark, data)
        raise
    return staged.follows + 1


def _create(spark: SparkSession, file: str, body: str) -> None:
    """Create a file that must not exist: the one step that two writers can't both do.

    The text is written under a name of its own, so a manifest is never seen half written. An empty marker
    is created exclusively; its holder renames the text into place, without replacing. A marker without a
    manifest that is older than LEASE_SECONDS is what a crashed writer left, and is taken away.
    """
    jvm = spark.sparkContext._jvm
    fs, target = _fs(spark, file)
    draft, marker = (jvm.org.apache.hadoop.fs.Path(f"{file}.{name}") for name in (f"{uuid.uuid4().hex}.draft", "owner"))
    out = fs.create(draft, False)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()
    try:
        if fs.exists(marker) and not fs.exists(target):
            age = time.time() - fs.getFileStatus(marker).getModificationTime() / 1000
            if age > LEASE_SECONDS:
                fs.delete(marker, False)
        fs.create(marker, False).close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri())
        none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files.rename(draft, target, none)
    except Exception as error:
        fs.delete(draft, False)
        raise PublishConflict(f"{file} belongs to another writer") from error


def _read_version(spark: SparkSession, path: str, version: str, schema: str) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{path}/data/{version}")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version that the last manifest names."""
    about = manifest(spark, path)
    if about is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return _read_version(spark, path, about["version"], about["schema"])


def sweep(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove versions that none of the last ``keep`` manifests names; how many. Run it when nobody writes."""
    fs, folder = _fs(spark, f"{path}/data")
    if not fs.exists(folder):
        return 0
    held = set()
    for number in range(max(1, _last(spark, path) - keep + 1), _last(spark, path) + 1):
        stream_fs, file = _fs(spark, _manifest(path, number))
        stream = stream_fs.open(file)
        held.add(json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["version"])
        stream.close()
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in held]
    for leftover in gone:
        fs.delete(leftover, True)
    return len(gone)


def footer_bounds(spark: SparkSession, path: str, *columns: str) -> dict[str, tuple[Any, Any]]:
    """(least, greatest) of columns of a Parquet table from the statistics in its file footers.

    The aggregate is pushed down to the scan, which then reads no column data. Types whose footers hold no
    exact bounds (strings, times) are not pushed down; they cost a scan of the column, with the same result.
    """
    reader = _footer_reader(spark)
    pairs = [f(c).alias(f"{n}_{k}") for k, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
    row = reader.read.parquet(path).agg(*pairs).first()
    return {c: (row[f"lo_{k}"], row[f"hi_{k}"]) for k, c in enumerate(columns)}


def _footer_reader(spark: SparkSession) -> SparkSession:
    """A session whose Parquet scans answer MIN, MAX and COUNT from footers; the caller's stays as it is."""
    reader = spark.newSession()
    reader.conf.set("spark.sql.sources.useV1SourceList", "")
    reader.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return reader


def footer_plan(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The frame behind ``footer_bounds`` of one column, for its plan."""
    return _footer_reader(spark).read.parquet(path).agg(F.min(column), F.max(column))
