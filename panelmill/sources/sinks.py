"""Sinks: guarded Parquet and CSV, Stata bytes for bounded tables, LaTeX and long result tables."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .readers import listing


class Half(RuntimeError):
    """What was written is not what was read."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def commit(df: DataFrame, path: str, *partition_by: str, kind: str = "parquet", overwrite: bool = False, counts: Mapping[str, Column] | None = None) -> dict[str, int]:
    """Writes a table so that it is there whole or not at all; returns ``n``, its rows, and the ``counts`` of rows that meet conditions.

    Rows go to a staging folder beside ``path`` and are counted on their way; what can be read back must be as many. Then
    the folder is renamed by the file system that holds it. An existing table is an error unless ``overwrite``, and is
    replaced only after the new one is complete. Whatever breaks, the staging folder goes and the old table stays.
    """
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(f"PATH_ALREADY_EXISTS: {path} is not overwritten")
    tag = uuid.uuid4().hex
    staging, aside = f"{path.rstrip('/')}.tmp-{tag}", f"{path.rstrip('/')}.old-{tag}"
    as_path = lambda p: _fs(spark, p)[1]
    seen = Observation()
    sums = [F.count(F.when(c, 1)).alias(name) for name, c in (counts or {}).items()]
    try:
        writer = df.observe(seen, F.count("*").alias("n"), *sums).write.option("compression", "zstd" if kind == "parquet" else "none").option("header", True)
        (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(staging)
        found = dict(seen.get)
        back = spark.read.option("header", True).format(kind).schema(df.schema).load(staging).count()
        if back != found["n"]:
            raise Half(f"{found['n']} rows were written to {path}, {back} can be read")
        fs.mkdirs(target.getParent())
        if fs.exists(target):
            if not fs.rename(target, as_path(aside)):
                raise Half(f"{path} could not be moved aside")
        if not fs.rename(as_path(staging), target):
            fs.rename(as_path(aside), target)
            raise Half(f"the staged table could not be renamed to {path}")
        fs.delete(as_path(aside), True)
    finally:
        if fs.exists(as_path(staging)):
            fs.delete(as_path(staging), True)
    return found


def write_once(df: DataFrame, path: str, *partition_by: str, kind: str = "parquet") -> int:
    """Never overwrites and leaves no half-written table behind; returns the number of rows."""
    return commit(df, path, *partition_by, kind=kind)["n"]


def warehouse_table(df: DataFrame, name: str, *partition_by: str) -> None:
    """A new table of Spark's SQL warehouse (``spark.sql.warehouse.dir``, shared by driver and executors), in folders by the columns named:
    a filter on one of them reads its folders alone. Never overwrites."""
    df.write.format("parquet").partitionBy(*partition_by).mode("errorifexists").saveAsTable(name)


def extract_each(spark: SparkSession, read: Callable[[str], DataFrame], parts: Sequence[str], path: str, *, workers: int = 4, retries: int = 0, kind: str = "parquet", must: Column | None = None) -> DataFrame:
    """One job a part (a state, a year), ``workers`` at a time, each committed on its own to ``path/<part>``.

    ``read`` gives a part's rows, as a warehouse query with that part's filter would. A part that is there is skipped, unread; one
    that fails is tried again ``retries`` times and then reported, and the others go on. Run it again, and only what is missing is read.
    Returns a report, a row a part: part, status (``written``, ``skipped``, ``failed``), n_rows, n_must (rows that meet the
    condition ``must``, of which a sound extract has some) and error.
    """

    def one(part: str) -> tuple:
        target = f"{path.rstrip('/')}/{quote(part, safe='')}"
        try:
            fs, where = _fs(spark, target)
            if fs.exists(where):
                return part, "skipped", None, None, None
        except Exception as error:  # noqa: BLE001  a part's failure is its own
            return part, "failed", None, None, _said(error)
        for left in range(retries, -1, -1):
            try:
                found = commit(read(part), target, kind=kind, counts={"n_must": must} if must is not None else None)
                return part, "written", found["n"], found.get("n_must"), None
            except Exception as error:  # noqa: BLE001
                if not left:
                    return part, "failed", None, None, _said(error)
        raise AssertionError

    with ThreadPoolExecutor(max_workers=workers) as pool:
        report = list(pool.map(one, map(str, parts)))
    return spark.createDataFrame(report, "part string, status string, n_rows long, n_must long, error string")


def _said(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:300]


def extract_parts(df: DataFrame, part: str, path: str, expected: Sequence) -> DataFrame:
    """Each part (a year, a state) of an extract in its own folder below ``path``, all new ones by one job.

    Parts that are there already are left alone and not read again. Returns a report, a row a part: part, status
    (``written``, ``skipped``, ``empty``: no row for it) and n_rows. Folders appear when the job commits, so a job that
    broke off leaves no part behind and can be run again.
    """
    spark = df.sparkSession
    there = _parts(spark, path, part)
    todo = [v for v in expected if str(v) not in there]
    if todo:
        rows = df.where(F.col(part).isin(todo))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    now = _parts(spark, path, part)
    # by the folders' names, as they are: a code like 01 would be read back as a number
    name = F.regexp_extract("_metadata.file_path", f"/{re.escape(part)}=([^/]*)/", 1)
    saved = spark.read.option("recursiveFileLookup", True).parquet(path).groupBy(name).count().collect() if now else []
    counts = {unquote(v): n for v, n in saved}
    report = [(str(v), "skipped" if str(v) in there else "written" if str(v) in now else "empty", counts.get(str(v), 0)) for v in expected]
    return spark.createDataFrame(report, "part string, status string, n_rows long")


def _parts(spark: SparkSession, path: str, part: str) -> set[str]:
    names = (re.search(rf"/{re.escape(part)}=([^/]*)/", file) for file, _ in listing(spark, path))
    return {unquote(m[1]) for m in names if m}


def stata_names(columns: Sequence[str], most: int = 32) -> dict[str, str]:
    """Names of at most 32 characters, made unique by a number."""
    out: dict[str, str] = {}
    for column in columns:
        name, k = column[:most], 1
        while name in out.values():
            tail = f"_{k}"
            name, k = column[: most - len(tail)] + tail, k + 1
        out[column] = name
    return out


def stata_bytes(rows: pd.DataFrame, labels: Mapping[str, str] | None = None) -> bytes:
    """A Stata file of a bounded table: long names shortened, null texts empty, nullable integers as doubles."""
    rows = rows.rename(columns=stata_names(list(rows.columns)))
    for column in rows.columns:
        if rows[column].dtype == object or pd.api.types.is_string_dtype(rows[column]):
            rows[column] = rows[column].fillna("").astype(str)
        elif pd.api.types.is_integer_dtype(rows[column]):
            rows[column] = rows[column].astype("float64" if rows[column].hasnans or rows[column].abs().max() > 2**31 - 1 else "int32")
    out = io.BytesIO()
    rows.to_stata(out, write_index=False, version=118, variable_labels={stata_names([k])[k]: v for k, v in (labels or {}).items()})
    return out.getvalue()


def stata_files(df: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """(content, n_rows): the rows as Stata files, one for each Arrow batch of a task (``spark.sql.execution.arrow.maxRecordsPerBatch``
    rows at most), so a file is bounded whatever the table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield pd.DataFrame({"content": [stata_bytes(rows, labels)], "n_rows": [len(rows)]})

    return df.mapInPandas(run, "content binary, n_rows long")


_ESCAPES = str.maketrans({"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"})


def latex_table(rows: pd.DataFrame, caption: str, note: str = "", digits: int = 3) -> str:
    """A booktabs table of a small result."""
    show = lambda v: "" if v is None or v != v else f"{v:,.{digits}f}" if isinstance(v, float) else str(v).translate(_ESCAPES)
    head = " & ".join(str(c).translate(_ESCAPES) for c in rows.columns)
    body = "\n".join(" & ".join(map(show, r)) + r" \\" for r in rows.itertuples(index=False))
    spec = "l" + "r" * (len(rows.columns) - 1)
    foot = f"\\begin{{tablenotes}}{note.translate(_ESCAPES)}\\end{{tablenotes}}\n" if note else ""
    return f"\\begin{{table}}\n\\caption{{{caption.translate(_ESCAPES)}}}\n\\begin{{tabular}}{{{spec}}}\n\\toprule\n{head} \\\\\n\\midrule\n{body}\n\\bottomrule\n\\end{{tabular}}\n{foot}\\end{{table}}\n"


def long_results(wide: DataFrame, by: Sequence[str], statistics: Mapping[str, Column]) -> DataFrame:
    """One row per group and statistic, from one wide aggregate."""
    row = wide.groupBy(*by).agg(F.array(*[F.struct(F.lit(k).alias("statistic"), c.cast("double").alias("value")) for k, c in statistics.items()]).alias("v"))
    return row.select(*by, F.explode("v").alias("v")).select(*by, "v.statistic", "v.value")


def sample_note(df: DataFrame, *person: str) -> DataFrame:
    """Rows and distinct people of a sample, for a table's note."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(F.struct(*person)).alias("n_people"))
