"""Import of a JSON document store: one object, table name to {id: document}."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.functions.exif import strip
from medialake.schemas import PROFILES

_EXIF = "struct<camera_make:string,camera_model:string,f_stop:double,exposure_time:string,iso:int,focal_length:string,captured_at:string,camera_profile:string,location:struct<latitude:double,longitude:double,altitude:double,datum:string>,flash_fired:boolean,focal_length_35mm:string,white_balance_mode:string,exposure_program:string,metering_mode:string,orientation:int,raw_tags:map<string,string>>"
_DOC = f"struct<file_hash:string,file_info:struct<name:string,path:string,size_bytes:long,mime_type:string>,dimensions:struct<width:int,height:int>,exif:{_EXIF},labels:array<string>,added_at:string>"


def normal(path):
    """Absolute path without links or dots, as a scan names it."""

    @F.pandas_udf("string")
    def real(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: os.path.realpath(p) if p else p)

    return real(path)


def typed(docs: DataFrame) -> DataFrame:
    """Library rows of documents whose times are texts.

    Missing labels and tags become empty, a missing datum WGS84, an unreadable
    capture time null and an unknown profile ``unknown``; an unreadable
    ``added_at`` or a place out of range raises.
    """
    place = F.col("exif.location")
    bad = (F.abs(place["latitude"]) > 90) | (F.abs(place["longitude"]) > 180)
    located = F.when(bad, F.raise_error(F.lit("place out of range"))).when(place.isNotNull(), F.struct(place["latitude"].alias("latitude"), place["longitude"].alias("longitude"), place["altitude"].alias("altitude"), F.coalesce(place["datum"], F.lit("WGS84")).alias("datum")))
    profile = F.when(F.col("exif.camera_profile").isin(*PROFILES), F.col("exif.camera_profile")).otherwise("unknown")
    exif = F.col("exif").withField("captured_at", strip(F.col("exif.captured_at")).try_cast("timestamp_ntz")).withField("camera_profile", profile).withField("location", located).withField("raw_tags", F.coalesce("exif.raw_tags", F.create_map().cast("map<string,string>")))
    return docs.select("file_hash", F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("file_info.path")).alias("norm_path"), "file_info", "dimensions", exif.alias("exif"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.col("added_at").cast("timestamp_ntz").alias("added_at"))


def read_documents(spark: SparkSession, path: str, name: str = "metadata") -> DataFrame:
    raw = spark.read.option("multiLine", True).schema(f"`{name}` map<string,{_DOC}>").json(path)
    docs = raw.select(F.explode(name).alias("doc_id", "d")).select("doc_id", "d.*")
    return typed(docs)
