"""Scans of files into the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = ["jpg", "jpeg", "png", "bmp", "webp"]


def documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """filename, path, sha256, content of a folder's files, subfolders left out; ordered by name where order matters."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(filename(F.col("path")).alias("filename"), "path", F.sha2("content", 256).alias("sha256"), "content")


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def labelled_images(spark: SparkSession, folder: str, label: int) -> DataFrame:
    """path, content, label of images in a folder and below, by extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(IMAGES)).select("path", "content", F.lit(label).alias("label"))


def images_by_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, content, label: the label is the name of the folder that holds the file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content", F.element_at(F.split("path", "/"), -2).alias("label"))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height, mode, data of a folder's images by extension, decoded in the JVM; broken files go."""
    files = spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.*")
    return listed(files.withColumnRenamed("origin", "path"), "path", *IMAGES).select("path", "width", "height", "mode", "data")


def listed(files: DataFrame, path: str, *extensions: str) -> DataFrame:
    """Files of some extensions, in whichever case."""
    return files.where(F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*extensions))


def training_subset(df: DataFrame, ident: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(training, validation) by a hash of the id, so a row keeps its side."""
    side = F.pmod(F.xxhash64(ident), F.lit(1000)) < int(share * 1000)
    return df.where(side), df.where(~side)


def text_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """text, label of a CSV file with quoted line breaks; blank texts and labels go.

    Raises ValueError if a column is missing."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if missing := {"text", "label"} - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return rows.select("text", "label").na.fill("").where("trim(text) <> '' and trim(label) <> ''")


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """class_number, class_name from a JSON object of name to number."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.explode(F.from_json("value", "map<string,int>")).alias("class_name", "class_number")).select("class_number", "class_name")


def table(spark: SparkSession, path: str, *, file_id: int | None = None) -> DataFrame:
    """A stored table, of one file if asked for."""
    rows = spark.read.parquet(path)
    return rows if file_id is None else rows.where(F.col("file_id") == file_id)


def copy_table(spark: SparkSession, source: str, target: str, columns: list[str]) -> None:
    """Append columns of another database's table; one job, so all rows or none."""
    spark.read.parquet(source).select(*columns).write.mode("append").parquet(target)


def clip_rect(rect: dict[str, Column], page: dict[str, Column]) -> dict[str, Column]:
    """A rectangle (x0, y0, x1, y1) put in order and cut to the page; keep it where ``ok``."""
    x0, x1 = F.least(rect["x0"], rect["x1"]), F.greatest(rect["x0"], rect["x1"])
    y0, y1 = F.least(rect["y0"], rect["y1"]), F.greatest(rect["y0"], rect["y1"])
    out = {"x0": F.greatest(x0, page["x0"]), "y0": F.greatest(y0, page["y0"]), "x1": F.least(x1, page["x1"]), "y1": F.least(y1, page["y1"])}
    finite = ~(F.isnan(rect["x0"]) | F.isnan(rect["y0"]) | F.isnan(rect["x1"]) | F.isnan(rect["y1"]))
    return out | {"ok": finite & (out["x1"] - out["x0"] > 1) & (out["y1"] - out["y0"] > 1)}
