"""What may be uploaded, the sizes images are worked at, and reading images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_up

# Accepted types and sizes in bytes.
IMAGE_TYPES = ["image/png", "image/jpeg", "image/jpg", "image/webp", "image/gif", "image/svg+xml", "image/avif"]
VIDEO_TYPES = ["video/mp4", "video/webm", "video/quicktime"]
IMAGE_BYTES, VIDEO_BYTES = 25 << 20, 200 << 20


def gate(mime: Column, size: Column) -> Column:
    """accepted, or why not."""
    most = F.when(mime.isin(VIDEO_TYPES), VIDEO_BYTES).otherwise(IMAGE_BYTES)
    return F.when(~mime.isin(IMAGE_TYPES + VIDEO_TYPES), "unsupported type").when(size > most, "too large").otherwise("accepted")


def raster_size(w: Column, h: Column, longest: int) -> Column:
    """struct(scale, width, height) of an image reduced so that its longer side is at most `longest`."""
    scale = F.greatest(F.lit(1.0), F.greatest(w, h) / float(longest))
    return F.struct(scale.alias("scale"), half_up(w / scale).alias("width"), half_up(h / scale).alias("height"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Images decoded by Spark's image source: origin, height, width, nChannels, data in BGR order. Broken files are dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, mime, outcome) of a folder's files, from their headers and names alone."""
    ends = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "svg": "image/svg+xml", "mp4": "video/mp4", "webm": "video/webm", "mov": "video/quicktime"}
    end = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    mime = F.coalesce(F.create_map(*(F.lit(x) for kv in ends.items() for x in kv))[end], F.lit("application/octet-stream"))
    out = spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), mime.alias("mime"))
    return out.withColumn("outcome", gate(F.col("mime"), F.col("size")))


def samples(spark: SparkSession) -> DataFrame:
    """The built-in examples."""
    return spark.createDataFrame([("sports", "Match day", "Sports Poster"), ("sale", "Summer sale", "Marketing Banner"), ("event", "Night concert", "Event Flyer")], "id string, name string, category string")
