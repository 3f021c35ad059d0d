"""Row types between stages, keyed by ``rel_path``."""

from pyspark.sql import types as T

LOCATION = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])

IMAGES = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("rel_path", T.StringType()), T.StructField("dir", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("base", T.StringType()), T.StructField("ext", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.DoubleType()),
])

EXIF = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()), T.StructField("location", LOCATION), T.StructField("coordinates", T.StringType()), T.StructField("camera", T.StringType()),
    T.StructField("focal_length", T.StringType()), T.StructField("aperture", T.StringType()), T.StructField("iso", T.StringType()), T.StructField("shutter_speed", T.StringType()),
])

METADATA = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()), T.StructField("datetime_min", T.TimestampNTZType()), T.StructField("datetime_max", T.TimestampNTZType()), T.StructField("datetime_source", T.StringType()),
    T.StructField("location", LOCATION), T.StructField("location_str", T.StringType()), T.StructField("location_error", T.StringType()), T.StructField("camera", T.StringType()), T.StructField("focal_length", T.StringType()),
    T.StructField("aperture", T.StringType()), T.StructField("iso", T.StringType()), T.StructField("shutter_speed", T.StringType()), T.StructField("filename", T.StringType()),
])

OUTPUT = T.StructType([T.StructField("rel_path", T.StringType()), T.StructField("text", T.StringType())])
ERRORS = T.StructType([T.StructField("rel_path", T.StringType()), T.StructField("error", T.StringType())])
#: What was read from an image's head, and of which file: read again when the file is another.
HEADS = T.StructType([T.StructField("rel_path", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.DoubleType()), T.StructField("exif", EXIF)])
