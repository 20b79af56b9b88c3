"""Readers: CSV by schema, Stata files, discovery of yearly inputs, caches."""

from __future__ import annotations

import io
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A path that driver and executors share: below ``spark.checkpoint.dir``. Where that is unset a local master takes a folder
    below the warehouse; a cluster has none to guess, so that raises ``ValueError``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{name}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut, and no part of it runs or is dealt twice."""
    path = scratch(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header, by an explicit schema; columns that a header lacks are null, others than the schema's are not read.

    Columns go by name, whatever their order and case; a byte order mark before the first name is none of it.
    """
    raw = read_text_columns(spark, paths, encoding)
    have = {c.lower(): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_text_columns(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """CSV with every column as text (dictionaries, raw extracts): types come from later coercion, never from inference."""
    df = spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding).csv(paths)
    # a mark read as Latin-1 is three characters
    return df.toDF(*[c.removeprefix("\ufeff").removeprefix("\u00ef\u00bb\u00bf") for c in df.columns])


def header(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Column names of a CSV or Parquet input: the header or footer is read, no row."""
    return read_text_columns(spark, path).columns if kind == "csv" else spark.read.format(kind).load(path).columns


def read_warehouse(spark: SparkSession, url: str, table: str, key: str | None = None, partition_rows: int = 1_000_000, **options: str) -> DataFrame:
    """A table of an SQL warehouse, by JDBC. Filters and columns of the query that follows travel to the warehouse, so a year's rows are
    all that leaves it; with a numeric ``key`` it is read in ranges of the key, as many as the rows need, side by side."""
    source = spark.read.format("jdbc").option("url", url).options(**options)
    if key is None:
        return source.option("dbtable", table).load()
    quoted = '"' + key + '"'
    low, high, n = source.option("dbtable", f"(select min({quoted}) low, max({quoted}) high, count(*) n from {table}) bounds").load().first()
    if not n or low is None:
        return source.option("dbtable", table).load()
    parts = max(1, -(-n // partition_rows))
    return source.option("dbtable", table).option("partitionColumn", key).option("lowerBound", int(low)).option("upperBound", int(high) + 1).option("numPartitions", parts).load()


def year_of(column: str = "_metadata.file_name"):
    """The year in a file's name, as in ``survey_2019.parquet``."""
    return F.regexp_extract(F.col(column), r"_((?:19|20)\d{2})\.", 1).try_cast("int")


def listing(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of every file at or below a path of any store that Spark reads; empty where there is nothing.

    Only names and sizes are read. The list is on the driver, so it is for folders of inputs, not for a whole store.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length") if present(spark, path) else None
    return [] if files is None else sorted((r.path, r.length) for r in files.collect())


def present(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path, in any store that Spark reads."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def discover(spark: SparkSession, folder: str, stem: str, years: Iterable[int], kinds: tuple[str, ...] = ("parquet", "csv", "dta")) -> dict[int, str]:
    """The preferred file or table of each year, at any depth of a folder; samples and empty ones do not count, and a year without one is an error."""
    sizes: Counter[str] = Counter()
    for path, length in listing(spark, folder):
        # a table is a folder of files: its name is the part of the path that carries the year
        if found := re.match(rf"(.*/({re.escape(stem)}[^/]*_((?:19|20)\d{{2}})\.(\w+)))(?:/|$)", path):
            sizes[found[1]] += length
    best: dict[int, str] = {}
    for path in sorted(p for p, n in sizes.items() if n):
        year, kind = int(re.search(r"_((?:19|20)\d{2})\.\w+$", path)[1]), path.rsplit(".", 1)[1]
        if "_sample_" in path.rsplit("/", 1)[1] or kind not in kinds:
            continue
        if year not in best or kinds.index(kind) < kinds.index(best[year].rsplit(".", 1)[1]):
            best[year] = path
    missing = sorted(set(years) - set(best))
    if missing:
        raise FileNotFoundError(f"no input for the years {missing}")
    return {y: best[y] for y in years}


def usable_files(spark: SparkSession, paths: Iterable[str], essential: Iterable[str]) -> tuple[list[str], dict[str, str]]:
    """CSV files that exist, hold bytes and have the essential columns in their header; and why the others do not.

    The header is read by Spark's CSV reader, so names may be quoted; one small read a file.
    """
    good, bad = [], {}
    for path in map(str, paths):
        if not present(spark, path):
            bad[path] = "missing"
        elif not sum(n for _, n in listing(spark, path)):
            bad[path] = "empty"
        elif lacking := sorted(set(essential) - set(read_text_columns(spark, path).columns)):
            bad[path] = f"lacks {lacking}"
        else:
            good.append(path)
    return good, bad


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table saved at ``path``; made and saved first where there is none or ``rebuild`` is set."""
    # the mark of a finished job: a folder that a broken job left has none, and only ``rebuild`` replaces it
    done = present(spark, f"{path.rstrip('/')}/_SUCCESS")
    if done and not rebuild:
        return spark.read.parquet(path)
    make().write.mode("overwrite" if rebuild else "errorifexists").parquet(path)
    return spark.read.parquet(path)


def read_dta(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Stata files, codes not labels; one file is one task, so large inputs belong in many files."""
    return read_dta_bytes(spark.read.format("binaryFile").load(paths).select("content"), schema)


def read_dta_bytes(files: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of Stata files given as bytes (``content``), in pieces; columns that are not in the schema are not kept."""
    names = schema.fieldNames()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            for content in batch.column("content").to_pylist():
                for chunk in pd.read_stata(io.BytesIO(content), convert_categoricals=False, chunksize=100_000):
                    piece = pa.RecordBatch.from_pandas(chunk[names], preserve_index=False)
                    yield pa.Table.from_batches([piece]).cast(to_arrow_schema(schema)).combine_chunks().to_batches()[0]

    return files.mapInArrow(run, schema)
