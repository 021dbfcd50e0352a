"""Sources of texts: folder trees of one file a field, catalogue files, parsers by suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.catalogue import section_codes

# The upper half of windows-1251, which Spark's decoder does not know by default. 0x98 has no character.
CP1251_UPPER = bytes(b for b in range(128, 256) if b != 0x98).decode("cp1251")
_LATIN_UPPER = "".join(chr(b) for b in range(128, 256) if b != 0x98)


def decode_cp1251(body: Column) -> Column:
    return F.translate(F.decode(body, "ISO-8859-1"), _LATIN_UPPER, CP1251_UPPER)


#: Parsers by file suffix; each makes a text of the bytes of a file. A file of another suffix has no parser and no text.
PARSERS = {"txt": decode_cp1251}


def parse_files(files: DataFrame, default: Column | None = None) -> DataFrame:
    """``files`` (with ``path`` and ``content``) plus ``text`` by the parser of the suffix, else ``default``."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.lit(None).cast("string") if default is None else default
    for name, parse in PARSERS.items():
        text = F.when(suffix == name, parse(F.col("content"))).otherwise(text)
    return files.withColumn("text", text)


def folder_fields(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """``(object_id, field_id, text, failure)`` of ``root/<object_id>/<field_id>``.

    Folders whose name is no number are passed over. A file is read by the parser of its suffix; one without a parser has
    no text and ``failure`` says so, or, if ``strict``, is an error as in the original. Paths are unique, so nothing is
    de-duplicated.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    named = files.withColumns({"object_id": folder.try_cast("long"), "field_id": F.regexp_extract("path", r"([^/]+)$", 1)}).where(F.col("object_id").isNotNull())
    known = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(PARSERS))
    message = F.concat(F.lit("no parser for "), F.col("field_id"))
    failure = F.when(~known, F.raise_error(message) if strict else message)
    return parse_files(named.withColumn("failure", failure.cast("string"))).select("object_id", "field_id", "text", "failure")


def list_folder(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of the files right in a folder, by name; nothing below it is listed and no content is read."""
    files = spark.read.format("binaryFile").load(root)
    return files.select("path", "length").orderBy("path")


def plain_catalogue(lines: DataFrame, line: str = "value") -> DataFrame:
    """Catalogue lines split at ``;`` without quoting. Missing trailing columns are null, unparsable numbers -1."""
    part = F.split(F.btrim(F.col(line)), ";")
    col = lambda i: F.get(part, F.lit(i))
    number = lambda i: F.coalesce(F.btrim(col(i)).try_cast("int"), F.lit(-1))
    return lines.select(
        col(0).try_cast("long").alias("object_id"), number(1).alias("year"), col(2).alias("udc"), section_codes([col(3), col(4), col(5)]).alias("lib_sections"),
        number(6).alias("pages_count"), col(7).alias("author"), col(8).alias("title"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return plain_catalogue(spark.read.text(path))
