"""Readers: ledgers, projects, manifests, registries, folders. All schemas are explicit and nothing unreadable fails a scan unless asked to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELEMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "element_type", "content", "image_path", "color")] + [T.StructField(n, T.DoubleType()) for n in ("x", "y", "width", "height", "x2", "y2", "font_size")]
)
PAGE = T.StructType([T.StructField("id", T.StringType()), T.StructField("elements", T.ArrayType(ELEMENT))])
PROJECT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "created_at", "modified_at")] + [T.StructField("pages", T.ArrayType(PAGE))])
ELEMENT_TYPES = ("text", "image", "rect", "line")
GLYPH = T.StructType(
    [T.StructField("char", T.StringType()), T.StructField("image_path", T.StringType()), T.StructField("quality_score", T.DoubleType()), T.StructField("tier", T.StringType()), T.StructField("index", T.IntegerType()), T.StructField("perceptual_hash", T.StringType()), T.StructField("profile_id", T.StringType())]
)


def json_records(spark: SparkSession, path: str | list[str], schema: T.StructType, strict: bool = False) -> DataFrame:
    """Records of JSON arrays or objects, pretty-printed or not. Unknown fields go, missing ones are null, and unreadable
    files give no rows; ``strict`` fails on them instead."""
    if strict:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("ignoreMissingFiles", True).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system it belongs to."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def json_or_backup(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of a file, or of its .bak if it is missing or holds none."""
    for p in (path, f"{path}.bak"):
        if exists(spark, p):
            found = json_records(spark, p, schema)
            if found.take(1):
                return found
    return spark.createDataFrame([], schema)


def normal_project(projects: DataFrame) -> DataFrame:
    """Projects whose elements of unknown type are texts, and with one empty page if there is none."""
    page = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.array().cast(T.ArrayType(ELEMENT)).alias("elements"))).cast(T.ArrayType(PAGE))
    fixed = F.transform("pages", lambda p: p.withField("elements", F.transform(F.coalesce(p["elements"], F.array().cast(T.ArrayType(ELEMENT))), lambda e: e.withField("element_type", F.when(e["element_type"].isin(*ELEMENT_TYPES), e["element_type"]).otherwise("text")))))
    return projects.withColumn("pages", F.when(F.size(F.coalesce("pages", F.array().cast(T.ArrayType(PAGE)))) > 0, fixed).otherwise(page))


def listing(spark: SparkSession, folder: str, recursive: bool = False, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, modified, length) of the files of a folder, without reading their contents; extensions in any case."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    files = read.load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions])) if extensions else files


def newest_first(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder).orderBy(F.desc("modified"), "path")


def manifest(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Manifest entries whose file is there; if the manifest gives none, entries from the file names."""
    files = listing(spark, folder, extensions=("png",)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    if exists(spark, path):
        rows = json_records(spark, path, GLYPH).where("image_path IS NOT NULL")
        if rows.take(1):
            return rows.withColumn("name", F.regexp_extract("image_path", "([^/]+)$", 1)).join(files, "name", "left_semi").drop("name")
    return entries_of_names(files)


def entries_of_names(files: DataFrame) -> DataFrame:
    """(char, image_path, index) from names {char}_{index} or punct_{code point}_{index}."""
    code = F.regexp_extract("name", r"^punct_([0-9]+)", 1)
    char = F.when(code != "", F.char(code.try_cast("int"))).otherwise(F.regexp_extract("name", r"^(.+?)_[0-9]+\.", 1))
    return files.select(char.alias("char"), F.col("name").alias("image_path"), F.coalesce(F.regexp_extract("name", r"_([0-9]+)\.[^.]*$", 1).try_cast("int"), F.lit(0)).alias("index")).where("char <> ''")


def ocr_words(rows: DataFrame) -> DataFrame:
    """Recognised boxes without blank texts and negative confidences; confidence as a share."""
    return rows.where((F.trim("text") != "") & (F.col("conf") >= 0)).withColumn("conf", F.col("conf") / 100)


def settings(defaults: dict, found: dict) -> dict:
    """Defaults overlaid with found values of the same type; others are ignored."""
    return {k: found[k] if k in found and type(found[k]) is type(v) else v for k, v in defaults.items()}


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def sentinels_to_null(rows: DataFrame, strings: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """Empty strings and -1 in the named columns as null."""
    null = lambda c, v: F.when(F.col(c) != F.lit(v), F.col(c))
    return rows.withColumns({**{c: null(c, "") for c in strings}, **{c: null(c, -1) for c in numbers}})


def cache_key(path: Column, modified: Column, length: Column, backend: Column, options: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, modified.cast("string"), length.cast("string"), backend, options).cast("binary"), 256)
