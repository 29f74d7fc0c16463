"""Readers: processed datasets, raw hospital tables, run records, vectors, input fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark import config as C
from cohortspark import schemas
from cohortspark.functions import values as V
from cohortspark.operators.cohort import benchmark_tasks, run_matches
from cohortspark.session import broadcast_if_small

#: an id list of this many rows is at most a few megabytes in every task
BROADCAST_IDS = 200_000
LITERAL_IDS = 500


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on whatever file system the path names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop)


def read_parquet(
    spark: SparkSession, path: str, schema: T.StructType | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """A Parquet file or a folder of part files; a missing path is a clear error."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no parquet at {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if columns is None else df.select(*columns)


def key_filter(df: DataFrame, ids: DataFrame | Sequence[int], key: str = "stay_id") -> DataFrame:
    """Rows of the listed keys. Short literal lists reach the Parquet scan as an IN filter."""
    if not isinstance(ids, DataFrame):
        ids = list(ids)
        if len(ids) <= LITERAL_IDS:
            return df.filter(F.col(key).isin(*ids))
        ids = df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} {dict(df.dtypes)[key]}")
    return df.join(broadcast_if_small(ids.select(key), BROADCAST_IDS), key, "left_semi")


class DatasetSource:
    """Base of the dataset adapters: a name, stays, series and named extra sources."""

    name = "dataset"

    def stays(self) -> DataFrame:
        raise NotImplementedError

    def timeseries(self, ids=None) -> DataFrame:
        raise NotImplementedError

    def sources(self) -> dict[str, Callable[[], DataFrame]]:
        return {"timeseries": self.timeseries, "stays": self.stays}

    def source(self, name: str, ids=None) -> DataFrame:
        known = self.sources()
        if name not in known:
            raise ValueError(f"unknown source {name!r}; this dataset has {sorted(known)}")
        df = known[name]()
        return df if ids is None else key_filter(df, ids)


class HourlyExport(DatasetSource):
    """A folder with ``stays``, ``timeseries``, ``mortality`` and ``diagnoses`` tables."""

    def __init__(self, spark: SparkSession, path: str, name: str = "dataset"):
        self.spark, self.path, self.name = spark, path, name

    def _table(self, name: str) -> str:
        folder, single = f"{self.path}/{name}", f"{self.path}/{name}.parquet"
        return folder if path_exists(self.spark, folder) else single

    def stays(self) -> DataFrame:
        return read_parquet(self.spark, self._table("stays"))

    def timeseries(self, ids=None) -> DataFrame:
        raw = read_parquet(self.spark, self._table("timeseries"))
        if ids is not None:
            raw = key_filter(raw, ids)
        return V.encode_categories(V.intervals_to_hours(raw))

    def sources(self):
        return {
            **super().sources(),
            "mortality_info": lambda: read_parquet(self.spark, self._table("mortality")),
            "diagnoses": lambda: read_parquet(self.spark, self._table("diagnoses")),
        }

    def metadata(self) -> dict:
        where = f"{self.path}/metadata"
        if not path_exists(self.spark, where):
            return {}
        row = self.spark.read.json(where).first()
        return row.asDict(recursive=True) if row else {}


def load_dataset(spark: SparkSession, path: str) -> dict:
    """The processed tables ``static, timeseries, labels``; ``metadata`` when present."""
    out: dict = {n: read_parquet(spark, f"{path}/{n}") for n in ("static", "timeseries", "labels")}
    where = f"{path}/metadata"
    out["metadata"] = spark.read.json(where) if path_exists(spark, where) else None
    return out


def read_raw_csv(
    spark: SparkSession, root: str, schema_dir: str, table: str, schema: T.StructType
) -> DataFrame:
    """``{root}/{schema_dir}/{table}.csv[.gz]``; a table that is not there is an empty frame."""
    for suffix in (".csv.gz", ".csv"):
        path = f"{root}/{schema_dir}/{table}{suffix}"
        if path_exists(spark, path):
            return spark.read.option("header", True).schema(schema).csv(path)
    return spark.createDataFrame([], schema)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path, schemas.EMBEDDINGS)


def read_runs(
    spark: SparkSession, path: str, state: str = "finished", revisions: Sequence[str] = (),
    filters: dict[str, Sequence[str]] | None = None, tasks: bool = True,
) -> DataFrame:
    """Run records from JSON lines or Parquet, filtered by state, revision and config or tag."""
    reader = spark.read.schema(schemas.RUNS)
    df = reader.parquet(path) if path.endswith(".parquet") else reader.json(path)
    return select_runs(df, state, revisions, filters, tasks)


def select_runs(df: DataFrame, state="finished", revisions=(), filters=None, tasks=True) -> DataFrame:
    if state:
        df = df.filter(F.col("state") == state)
    wanted = {"revision": revisions, **(filters or {})}
    names = [k for k, v in wanted.items() if v]
    for k in names:
        stated = V.config_value("config", k)
        if k == "paradigm":
            stated = F.coalesce(stated, V.config_value("config", "ssl.name"))
        df = df.withColumn("_f", stated)
        df = df.filter(run_matches("_f", "tags", k, wanted[k])).drop("_f")
    if tasks:
        df = benchmark_tasks(df.withColumn("task", V.config_value("config", "task.task_name"))).drop("task")
    return df


# --- fingerprints of inputs -------------------------------------------------------------

def input_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, modified) of a Parquet input, from the file listing: no file is read.

    Files count as for the Parquet reader: whatever their suffix, unless the name starts with _ or a dot.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "[^_.]*").load(path)
    return listed.select(
        F.col("path").alias("file_path"), F.col("length").alias("file_size"),
        F.col("modificationTime").alias("file_modification_time"),
    )


def input_signature(spark: SparkSession, paths: Sequence[str], settings: Sequence[str] = ()) -> str:
    """Hash over the files of all inputs and the settings that shape the output."""
    files = None
    for p in paths:
        one = input_files(spark, p)
        files = one if files is None else files.unionByName(one)
    h = F.xxhash64("file_path", "file_size", "file_modification_time")
    row = files.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x")
    ).select(
        F.sha2(F.concat_ws("|", "n", "x", *[F.lit(str(s)) for s in settings]), 256).alias("s")
    ).first()
    return row["s"]


def default_signature_settings() -> list[str]:
    return [*C.BLOCKED_FEATURES, str(C.SEQ_LENGTH_HOURS), str(C.LABEL_HORIZON_HOURS)]


