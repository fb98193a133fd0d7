"""Sources: each is a lazy DataFrame; files that cannot be read become rows of a second one."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

DOCUMENT = "id string, url string, title string, language string, content string, metadata map<string,string>"


def jsonl(spark: SparkSession, path: str, least: int = 120, schema: str = DOCUMENT) -> DataFrame:
    """Documents of a JSON-lines file that are no duplicates and have ``least`` characters when clean."""
    rows = spark.read.schema(schema).json(path)
    clean = T.clean_document(F.col("content"))
    return rows.where(F.try_element_at("metadata", F.lit("duplicate_of")).isNull()).withColumn("content", clean).where(F.length("content") >= least)


def json_array(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_tree(spark: SparkSession, root: str, schema: str, name: str = "data.json") -> DataFrame:
    """Every file of that name below a root, with its path."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def zip_pages(spark: SparkSession, path: str, member: str = "data.json") -> tuple[DataFrame, DataFrame]:
    """(pages, failures) of zip archives: a page is a folder below '/pages/' with the member in it.

    One archive is read by one task; many archives by many. Folders without the member, or with one
    that is not JSON, are failures with a reason.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    folders: dict[str, dict[str, str]] = {}
                    for name in archive.namelist():
                        head, _, tail = name.rpartition("/")
                        if "/pages/" in f"/{head}/" and tail:
                            folders.setdefault(head, {})[tail] = name
                    for folder, members in sorted(folders.items()):
                        lang = "ar" if "/AR/" in f"/{folder}/" else "en" if "/EN/" in f"/{folder}/" else None
                        if lang is None:
                            continue
                        if member not in members:
                            rows.append((folder, lang, None, f"no {member}"))
                            continue
                        data = archive.read(members[member]).decode("utf-8", "replace")
                        try:
                            json.loads(data)
                            rows.append((folder, lang, data, None))
                        except ValueError as error:
                            rows.append((folder, lang, None, f"bad JSON: {error}"))
                yield pd.DataFrame(rows, columns=["folder", "language", "data", "reason"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "folder string, language string, data string, reason string")
    return found.where("reason is null").select("folder", "language", "data"), found.where("reason is not null").select("folder", "reason")


def valid(rows: DataFrame, as_of: str, keys: tuple[str, ...] = ("status", "valid_until")) -> DataFrame:
    """Approved rows that are valid at a date, that day included; a missing governance column is an error."""
    missing = [k for k in keys if k not in rows.columns]
    if missing:
        raise ValueError(f"governance columns missing: {', '.join(missing)}")
    return rows.where((F.col("status") == "approved") & (F.to_date("valid_until") >= F.to_date(F.lit(as_of))))


def merged(cleaned: DataFrame | None, rescraped: DataFrame, curated: DataFrame, key: str, order: str) -> DataFrame:
    """Rescraped rows override cleaned ones by key; curated ones only fill keys that no other has."""
    from corpusloom.operators.corpus import keyed_override

    return keyed_override(curated, *([cleaned] if cleaned is not None else []), rescraped, key=key, order=order)


def pdf_documents(catalog: DataFrame, texts: DataFrame, least: int = 40) -> DataFrame:
    """(id, url, title, language, content, pages) of catalogued PDFs (url, title, languages, pages) whose text is long enough."""
    rows = catalog.join(texts.where(F.length("content") >= least), "url")
    slug = F.regexp_replace(F.regexp_extract("url", "([^/]+?)(\\.pdf)?$", 1), "[^A-Za-z0-9]+", "_")
    return rows.select(F.concat(F.lit("PDF_"), F.substring(slug, 1, 40)).alias("id"), "url", "title", F.when(F.array_contains("languages", "ar"), "ar").otherwise("en").alias("language"), "content", F.slice(F.sort_array("pages"), 1, 5).alias("pages"))
