"""Table scans with stated schemas.  NaN becomes null at ingest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymora.operators.ordered import first_per_key, null_safe_join, with_sorted_index

CLASSIFICATION = "array<struct<name:string,radio_answer:struct<name:string,value:string>,checklist_answers:array<struct<name:string>>>>"
LABEL_EXPORT = (
    "data_row struct<external_id:string>, projects map<string,struct<labels:array<struct<annotations:struct<"
    f"objects:array<struct<name:string>>,classifications:{CLASSIFICATION}>>>>>"
)


def nan_as_null(df: DataFrame) -> DataFrame:
    fixed = {n: F.when(~F.isnan(n), F.col(n)) for n, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fixed) if fixed else df


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",", pattern: str | None = None) -> DataFrame:
    """Delimited text with a header row; the file name is kept for provenance."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("nanValue", "NaN")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.csv(path)
    return nan_as_null(df.select("*", F.col("_metadata.file_path").alias("file_path"))).drop("file_path")


def read_table_with_source(
    spark: SparkSession, path: str, schema: str, source: str = "source", pattern: str = "*.csv", exclude: str | None = None
) -> DataFrame:
    """Many files as one table; the folder or file stem names the source of each row."""
    reader = spark.read.schema(schema).option("header", True).option("pathGlobFilter", pattern)
    reader = reader.option("recursiveFileLookup", True)
    df = reader.csv(path).select("*", F.col("_metadata.file_path").alias("file_path"))
    if exclude:
        df = df.filter(~F.col("file_path").contains(exclude))
    return df.withColumn(source, F.regexp_extract("file_path", r"([^/=]+)/[^/]*$", 1)).drop("file_path")


def read_count_matrix(spark: SparkSession, path: str, samples: Sequence[str], key: str = "gene_id") -> DataFrame:
    """Tab-separated count matrix with comment lines, kept long: one row per key and sample."""
    lines = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(path)
    wide = lines.select(F.col(lines.columns[0]).alias(key), *[F.col(f"`{s}`").cast("long").alias(s) for s in samples])
    return wide.unpivot([key], list(samples), "sample", "n")


def read_label_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_EXPORT).json(path)


def count_label_objects(exports: DataFrame) -> DataFrame:
    """Objects in the first label of the first project; 0 where any part is absent."""
    project = F.try_element_at(F.map_values("projects"), F.lit(1))
    objects = F.try_element_at(project["labels"], F.lit(1))["annotations"]["objects"]
    n = F.size(F.coalesce(objects, F.array().cast("array<struct<name:string>>")))
    return exports.select(F.col("data_row.external_id").alias("image"), n.alias("n_objects"))


def label_answers(exports: DataFrame, question: str, allowed: Sequence[str]) -> DataFrame:
    """One row per answered classification of one question."""
    labels = exports.select(
        F.col("data_row.external_id").alias("external_id"), F.explode(F.map_values("projects")).alias("p")
    ).select("external_id", F.explode("p.labels").alias("l"))
    rows = labels.select("external_id", F.explode("l.annotations.classifications").alias("c"))
    return rows.filter((F.col("c.name") == question) & F.col("c.radio_answer.value").isin(*allowed)).select(
        "external_id", F.col("c.radio_answer.value").alias("classification")
    )


def label_classes(exports: DataFrame) -> DataFrame:
    """Class and part of each mask, lower case; an unstated part of a whole animal is 'whole'."""
    project = F.try_element_at(F.map_values("projects"), F.lit(1))
    found = F.try_element_at(project["labels"], F.lit(1))["annotations"]["classifications"]
    found = F.coalesce(found, F.array().cast(CLASSIFICATION))

    def last_of(question: str, pick) -> Column:
        hits = F.filter(found, lambda c: c["name"] == question)
        answers = F.filter(F.transform(hits, pick), lambda a: a.isNotNull())
        return F.lower(F.coalesce(F.try_element_at(answers, F.lit(-1)), F.lit("")))

    cls = last_of("id", lambda c: c["radio_answer"]["name"])
    part = last_of("worm_part", lambda c: F.try_element_at(c["checklist_answers"], F.lit(1))["name"])
    return exports.select(
        F.col("data_row.external_id").alias("mask"),
        cls.alias("class"),
        F.when((part == "") & (cls == "worm"), "whole").otherwise(part).alias("part"),
    )


def flatten_record(df: DataFrame, scalars: Sequence[str], arrays: Sequence[str], index: str = "frame") -> DataFrame:
    """Nested record to one row per position: scalars repeat, short arrays end in nulls."""
    return df.select(*scalars, F.posexplode(F.arrays_zip(*arrays)).alias(index, "z")).select(
        *scalars, index, *[F.col(f"z.{a}").alias(a) for a in arrays]
    )


def first_folders(df: DataFrame, folder: str, max_files: int | None = None) -> DataFrame:
    """Rows of the first ``max_files`` records by name, or of all."""
    if max_files is None:
        return df
    names = df.select(folder).distinct().orderBy(folder).limit(max_files)
    return null_safe_join(df, names, [folder], "left_semi")


def summary_rows(df: DataFrame, columns: dict[str, str], order: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for old, new in columns.items()]).orderBy(*order)


def frame_interval(video_fps: Column, fps: Column) -> Column:
    return F.greatest(F.floor(video_fps / fps), F.lit(1)).cast("long")


def frame_inventory(videos: DataFrame, existing: DataFrame, total: str, interval: Column) -> DataFrame:
    """Missing and unexpected frames of each video against range(0, total, interval)."""
    expected = (
        videos.filter(F.col(total) > 0)
        .withColumn("__step", interval)
        .select("video_id", F.explode(F.sequence(F.lit(0), F.col(total) - 1, F.col("__step"))).alias("frame"))
    )
    keys = ["video_id", "frame"]
    missing = null_safe_join(expected, existing.select(*keys).distinct(), keys, "left_anti")
    extra = null_safe_join(existing.select(*keys).distinct(), expected, keys, "left_anti")
    return missing.withColumn("state", F.lit("missing")).unionByName(extra.withColumn("state", F.lit("unexpected")))


def unprocessed(inputs: DataFrame, outputs: DataFrame, key: str, also: DataFrame | None = None) -> DataFrame:
    """Inputs without a matching output; with ``also``, only those that have that other output."""
    todo = inputs if also is None else null_safe_join(inputs, also.select(key).distinct(), [key], "left_semi")
    return null_safe_join(todo, outputs.select(key).distinct(), [key], "left_anti")


def clip_frames(df: DataFrame, video_fps: Column, start_s: Column, duration_s: Column, total: Column, fps: Column | None = None) -> DataFrame:
    """Frames of a time span at a lower rate; seconds times rate is truncated."""
    start = F.least(F.floor(start_s * video_fps), total - 1)
    end = F.least(F.floor((start_s + duration_s) * video_fps), total)
    step = frame_interval(video_fps, fps if fps is not None else video_fps)
    f = F.col("frame")
    return df.filter((f >= start) & (f < end) & ((f - start) % step == 0))


def keep_replicates(manifest: DataFrame, name: str, extension: str = ".png", marker: str = "a") -> DataFrame:
    """Files of one extension whose second-last name part lacks the marker."""
    part = F.try_element_at(F.split(F.col(name), "_"), F.lit(-2))
    return manifest.filter(F.col(name).endswith(extension) & ~F.coalesce(part.contains(marker), F.lit(False)))


def file_frame_number(name: Column, extension: str = "tif") -> Column:
    digits = F.regexp_extract(name, rf"(\d+)\.{extension}$", 1)
    return F.coalesce(digits.try_cast("long"), F.lit(0))


def first_frames(manifest: DataFrame, folder: str, name: str, n: int) -> DataFrame:
    """First n files of each folder in numeric order of the frame number."""
    df = manifest.withColumn("frame_number", file_frame_number(F.col(name)))
    ranked = with_sorted_index(df, [folder], ["frame_number", name], "position", 1)
    return ranked.filter(F.col("position") <= n)


def split_duplicates(lines: DataFrame, text: str, order: str) -> tuple[DataFrame, DataFrame]:
    """First occurrence of each line, and how often the other lines repeat."""
    unique = first_per_key(lines, [text], [order])
    repeated = lines.groupBy(text).agg((F.count(F.lit(1)) - 1).alias("extra")).filter(F.col("extra") > 0)
    return unique, repeated


#: Pixels that one Arrow batch of unpacked images holds.
BATCH_CELLS = 1 << 19


def unpack_images(images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of an image scan (height, width, nChannels, data) to one row per pixel and channel.

    Bytes are taken apart batch by batch; an image whose data end early gives the pixels it has, one without data none.
    """
    fields = [f for k in keys for f in images.schema.fields if f.name == k]
    schema = T.StructType([*fields, *(T.StructField(c, T.IntegerType()) for c in ("y", "x", "channel")), T.StructField("intensity", T.DoubleType())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                height, width, channels, data = (row.column(len(keys) + c)[0].as_py() for c in range(4))
                cells = np.frombuffer(data or b"", np.uint8)[: (height or 0) * (width or 0) * (channels or 0)]
                for lo in range(0, len(cells), BATCH_CELLS):
                    values = cells[lo : lo + BATCH_CELLS]
                    at = lo + np.arange(len(values))
                    y, rest = np.divmod(at, width * channels)
                    x, channel = np.divmod(rest, channels)
                    own = [row.column(c).take(pa.array(np.zeros(len(values), np.int64))) for c in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(c.astype(np.int32)) for c in (y, x, channel)), pa.array(values.astype(float))], names=schema.names)

    return images.select(*keys, "height", "width", "nChannels", "data").mapInArrow(unpack, schema)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image folder to pixel rows keyed by the file path."""
    df = spark.read.format("image").load(path).select("image.*")
    return unpack_images(df, ["origin"])


def split_entries(texts: DataFrame, text: str) -> DataFrame:
    """Bibliography text to entries with their key and journal."""
    parts = texts.select(F.explode(F.split(F.col(text), r"\n@")).alias("entry"))
    parts = parts.filter(F.trim(F.col("entry")) != "").select(F.concat(F.lit("@"), F.trim("entry")).alias("entry"))
    return parts.select(
        "entry",
        F.regexp_extract("entry", r"@\w+\{([^,]+),", 1).alias("key"),
        F.trim(F.regexp_extract("entry", r'(?i)journal\s*=\s*["{](.+?)["}]', 1)).alias("journal"),
    )


def profile_structure(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per array column: type, row count, shortest and longest length, and a sample of three values."""
    kinds = dict(df.dtypes)
    measures = []
    for c in columns:
        measures += [
            F.min(F.size(c)).alias(f"{c}__min"),
            F.max(F.size(c)).alias(f"{c}__max"),
            F.count(c).alias(f"{c}__n"),
            F.min(F.slice(F.col(c), 1, 3)).alias(f"{c}__sample"),
        ]
    one = df.agg(*measures)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.lit(kinds[c]).alias("kind"),
                F.col(f"{c}__n").alias("n_records"),
                F.col(f"{c}__min").cast("long").alias("shortest"),
                F.col(f"{c}__max").cast("long").alias("longest"),
                F.col(f"{c}__sample").cast("array<string>").alias("sample"),
            )
            for c in columns
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


MASK_RUNS = T.StructType().add("size", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.LongType()))
