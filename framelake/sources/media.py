"""Media discovery, format registries, content hashes, probe records and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name extensions by kind.
VIDEO = "mp4 mov m4v mxf mkv avi mts braw r3d".split()
PHOTO = "jpg jpeg png tif tiff heic heif dng cr2 cr3 nef arw orf raf rw2".split()
UNSUPPORTED = "avif jxl erf iiq 3fr x3f gpr mrw pef srw".split()
JVM_DECODED = "jpg jpeg png tif tiff".split()

PROBE = "streams array<struct<codec_type string, codec_name string, profile string, codec_tag_string string, width long, height long, avg_frame_rate string, r_frame_rate string, pix_fmt string, bits_per_raw_sample string, duration string>>, format struct<duration string, size string, format_name string>"


def extension(path: Column) -> Column:
    """Lower-case extension of a path; null without one."""
    ext = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    return F.when(ext != "", ext)


def media_kind(path: Column) -> Column:
    """video, photo, unsupported (known, not decoded) or null for other files."""
    ext = extension(path)
    return F.when(ext.isin(VIDEO), "video").when(ext.isin(PHOTO), "photo").when(ext.isin(UNSUPPORTED), "unsupported")


def discover(spark: SparkSession, root: str, hashes: bool = False) -> DataFrame:
    """Media files below a folder: ``path``, ``size``, ``modified``, ``kind`` and, if asked for, ``sha256``.

    Without hashes file contents aren't read. Other files are left out; a path is listed once.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    columns = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), media_kind(F.col("path")).alias("kind")]
    if hashes:
        columns.append(F.sha2("content", 256).alias("sha256"))
    return files.select(*columns).where("kind is not null")


def support_matrix(spark: SparkSession) -> DataFrame:
    """Every known extension with its kind and whether the JVM decodes it."""
    rows = [(e, k, k == "photo" and e in JVM_DECODED) for k, es in (("video", VIDEO), ("photo", PHOTO), ("unsupported", UNSUPPORTED)) for e in es]
    return spark.createDataFrame(rows, "extension string, kind string, jvm_decoded boolean")


def frame_rate(text: Column) -> Column:
    """Frames a second from a number or a ratio; null unless positive."""
    clean = F.trim(text)
    top = F.try_to_number(F.regexp_extract(clean, r"^(\d+)\s*/\s*(\d+)$", 1), F.lit("999999999")).cast("double")
    low = F.try_to_number(F.regexp_extract(clean, r"^(\d+)\s*/\s*(\d+)$", 2), F.lit("999999999")).cast("double")
    plain = F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)$", 1).try_cast("double")
    rate = F.when(clean.contains("/"), F.when(low > 0, top / low)).otherwise(plain)
    return F.when(rate > 0, rate)


def frame_size(text: Column) -> tuple[Column, Column]:
    """(width, height) of ``WIDTHxHEIGHT``."""
    return F.regexp_extract(text, r"^\s*(\d+)\s*[x×]\s*(\d+)\s*$", 1).try_cast("long"), F.regexp_extract(text, r"^\s*(\d+)\s*[x×]\s*(\d+)\s*$", 2).try_cast("long")


def parse_probe(rows: DataFrame, json: str) -> DataFrame:
    """Columns of a stored probe record: duration, fps (average, else nominal), size, codec, audio, bit depth."""
    out = rows.withColumn("_p", F.from_json(json, PROBE))
    video = F.element_at(F.filter(F.coalesce("_p.streams", F.array()), lambda s: s["codec_type"] == "video"), 1)
    out = out.withColumn("_v", F.when(F.size(F.filter("_p.streams", lambda s: s["codec_type"] == "video")) > 0, video))
    fps = F.coalesce(frame_rate(F.col("_v.avg_frame_rate")), frame_rate(F.col("_v.r_frame_rate")))
    return out.select(
        *rows.columns,
        F.coalesce(F.col("_p.format.duration").try_cast("double"), F.col("_v.duration").try_cast("double")).alias("duration_s"),
        fps.alias("fps"), F.col("_v.width").alias("width"), F.col("_v.height").alias("height"), F.col("_v.codec_name").alias("codec"), F.col("_v.bits_per_raw_sample").try_cast("int").alias("bit_depth"),
        F.coalesce(F.exists("_p.streams", lambda s: s["codec_type"] == "audio"), F.lit(False)).alias("has_audio"),
    )


def unknown_keys(json: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object outside a closed set, sorted; null for what is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in allowed])))


def write_scores(rows: DataFrame, path: str) -> None:
    """``t_s,score`` with six decimals as CSV."""
    rows.select(F.format_string("%.6f", F.col("t").cast("double")).alias("t_s"), F.format_string("%.6f", F.col("score").cast("double")).alias("score")).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def catalogue(spark: SparkSession, root: str, url: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(source clips, segments) from Parquet exports below ``root``, or over JDBC if ``url`` is given."""
    if url:
        return tuple(spark.read.format("jdbc").options(url=url, dbtable=t).load() for t in ("source_clips", "segments"))  # type: ignore[return-value]
    return spark.read.parquet(f"{root}/source_clips.parquet"), spark.read.parquet(f"{root}/segments.parquet")
