"""Files of labels, images, lines and word lists as DataFrames, and the sinks of the results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tramloom.functions import text as X

LABELS = "image_id string, ocr_text string, product_name string"
IMAGE_FILES = "*.{jpg,jpeg,png,webp,bmp,pgm,ppm,JPG,JPEG,PNG,WEBP,BMP}"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of labels with header; NULL texts are empty. Missing columns are an error."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = {c.split()[0] for c in LABELS.split(", ")} - set(df.columns)
    if missing:
        raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
    return df.select(*[X.empty(F.col(c.split()[0])).alias(c.split()[0]) for c in LABELS.split(", ")])


def sample_labels(df: DataFrame, n: int, mode: str = "head", seed: int = 42, order: str = "image_id", keep_blank: bool = False) -> DataFrame:
    """``n`` labels from the head, the tail or at random; ones with blank text only with ``keep_blank``."""
    df = df if keep_blank else df.where(F.coalesce(F.trim("ocr_text") != "", F.lit(False)))
    by = {"head": F.asc(order), "tail": F.desc(order), "random": F.asc(F.xxhash64(order, F.lit(seed)))}[mode]
    return df.orderBy(by).limit(n)


def read_ids(spark: SparkSession, paths: list[str], limit: int | None = None) -> DataFrame:
    """(image_id, ord) of the first file that exists, in file order; with ``limit`` the head."""
    for path in paths:
        try:
            df = spark.read.option("header", True).csv(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        ids = df.select("image_id").withColumn("ord", F.monotonically_increasing_id())
        return ids.orderBy("ord").limit(limit) if limit else ids
    raise FileNotFoundError(", ".join(paths))


def index_images(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, path): image files under ``folder``, the first path of each stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_FILES).load(folder).select("path")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.groupBy(stem.alias("stem")).agg(F.min("path").alias("path"))


def densest_folder(images: DataFrame) -> DataFrame:
    """(folder, n): the folder with the most images."""
    return images.groupBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(1)


def resolve_images(ids: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, path): the file of each id, given as a path, or as a name with or without its extension; NULL where there is
    none."""
    stem = F.regexp_replace(F.regexp_extract(F.col(key), r"([^/]*)$", 1), r"\.[A-Za-z]+$", "")
    own = images.select("stem", "path", F.regexp_replace("path", r"^file:/*", "/").alias("plain"))
    found = ids.select(key, stem.alias("stem")).join(own, "stem", "left")
    fits = ~F.col(key).contains("/") | F.col("plain").endswith(F.col(key))
    return found.select(key, F.when(fits, F.col("path")).alias("path"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(token): distinct lower-case words of a file with one on each line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("token")).where("token <> ''").distinct()


def write_table(df: DataFrame, path: str, order: str | None = None, most: int = 1_000_000) -> None:
    """A table for people as CSV with header, in order: one file up to ``most`` rows, beyond that files in order of their
    names."""
    few = df.limit(most + 1).count() <= most
    out = (df.coalesce(1).sortWithinPartitions(order) if few else df.orderBy(order)) if order else (df.coalesce(1) if few else df)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_audit(rows: DataFrame, summary: DataFrame, path: str, order: str) -> None:
    """The rows of an audit as CSV and its summary, a small table, as JSON beside it."""
    write_table(rows, path, order)
    summary.coalesce(1).write.mode("overwrite").json(f"{path}.summary.json")


def write_new_configs(rows: DataFrame, path: str, config: str = "config") -> None:
    """Appends the rows of the configurations that the table at ``path``, laid out by them, doesn't hold yet."""
    spark = rows.sparkSession
    try:
        rows = rows.join(spark.read.parquet(path).select(F.col(config).cast(rows.schema[config].dataType).alias(config)).distinct(), config, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").partitionBy(config).parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the parquet table at ``path`` doesn't hold yet, the first of each key."""
    spark = df.sparkSession
    first = df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*df.columns)))).where("__r = 1").drop("__r")
    try:
        first = first.join(spark.read.parquet(path).select(key), key, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    first.write.mode("append").parquet(path)
