"""Table definitions in XML, and settings in properties files."""

from __future__ import annotations

import logging
import re
import xml.etree.ElementTree as ElementTree
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yearfold.functions.scalars import yes

log = logging.getLogger(__name__)

#: Where definitions lie below a project, and the folders of new and of changed tables.
BASES = ("modules", "modules_core", "build/*/modules")
TABLES, CHANGED = "src-db/database/model/tables", "src-db/database/model/modifiedTables"


def _s(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


SCHEMA = T.StructType([*_s("_name", "_primaryKey", "_isView"), T.StructField("column", T.ArrayType(T.StructType(_s("_name", "_type", "_size", "_required", "_primaryKey")))), T.StructField("foreign-key", T.ArrayType(T.StructType([*_s("_name", "_foreignTable", "_onDelete"), T.StructField("reference", T.ArrayType(T.StructType(_s("_local", "_foreign"))))])))])
READ = "file_order int, file string, table_name string, primary_key string, is_view boolean, columns array<struct<name:string,type:string,size:string,required:string,primaryKey:string>>, keys array<struct<name:string,target:string,on_delete:string,references:array<struct<local:string,foreign:string>>>>"


def find(root: str) -> list[str]:
    """Definition files in order, no file twice: of each base folder and its sub-folders, new tables, then changed ones; last the root's new tables."""
    top, seen = Path(root), {}
    folders = []
    for base in (b for pattern in BASES for b in sorted(top.glob(pattern)) if b.is_dir()):
        places = [base, *sorted(p for p in base.iterdir() if p.is_dir())]
        folders += [place / folder for folder in (TABLES, CHANGED) for place in places]
    for folder in [*folders, top / TABLES]:
        for f in sorted(folder.glob("*.xml")):
            seen.setdefault(str(f), None)
    return list(seen)


def has_doctype(file: str) -> bool:
    return re.search(r"<!DOCTYPE", Path(file).read_text(errors="replace"), re.I) is not None


def read(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file_order, file, table_name, primary_key, is_view, columns, keys) of each table element.

    Files with a document type are refused; files that cannot be parsed are left out. A definition
    keeps all columns of a compound key.
    """
    for f in files:
        if has_doctype(f):
            raise ValueError(f"{f} has a document type")
    if not files:
        return spark.createDataFrame([], READ)
    order = spark.createDataFrame([(i, str(Path(f).resolve())) for i, f in enumerate(files)], "file_order int, file string")
    df = spark.read.format("xml").option("rowTag", "table").option("mode", "DROPMALFORMED").schema(SCHEMA).load([str(Path(f).resolve()) for f in files])
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    df = df.withColumn("file", F.regexp_replace(place, "^file:/+", "/"))
    cols = F.transform("column", lambda c: F.struct(c["_name"].alias("name"), c["_type"].alias("type"), c["_size"].alias("size"), c["_required"].alias("required"), c["_primaryKey"].alias("primaryKey")))
    refs = lambda k: F.transform(k["reference"], lambda r: F.struct(r["_local"].alias("local"), r["_foreign"].alias("foreign")))
    keys = F.transform(F.col("`foreign-key`"), lambda k: F.struct(k["_name"].alias("name"), k["_foreignTable"].alias("target"), k["_onDelete"].alias("on_delete"), refs(k).alias("references")))
    out = df.select("file", F.col("_name").alias("table_name"), F.col("_primaryKey").alias("primary_key"), yes(F.col("_isView")).alias("is_view"), cols.alias("columns"), keys.alias("keys"))
    return out.join(F.broadcast(order), "file").select("file_order", "file", "table_name", "primary_key", "is_view", "columns", "keys")


def _stem(definitions: DataFrame):
    return F.lower(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.xml$", ""))


def of_table(definitions: DataFrame, table: str) -> DataFrame:
    """Definitions whose file or table element is named so, in any case."""
    return definitions.where((_stem(definitions) == table.lower()) | (F.lower("table_name") == table.lower()))


def of_file(definitions: DataFrame, table: str) -> DataFrame:
    """Definitions whose file is named so, in any case."""
    return definitions.where(_stem(definitions) == table.lower())


def columns_of(definitions: DataFrame) -> DataFrame:
    """(table_name, file_order, place, column_name, type, size, required) of each defined column."""
    c = definitions.select("table_name", "file_order", F.posexplode("columns").alias("place", "c"))
    return c.select("table_name", "file_order", "place", F.col("c.name").alias("column_name"), F.col("c.type").alias("type"), F.col("c.size").alias("size"), F.col("c.required").alias("required"))


def is_changed_file(file: str) -> bool:
    return Path(CHANGED).name in Path(file).parts


def key_name(definitions: DataFrame, files: list[str]) -> str | None:
    """The name of a table's key, by the first of its files that is not of changed tables: None unless that has one table element, which names it."""
    first = next((f for f in files if not is_changed_file(f)), None)
    if first is None:
        return None
    rows = definitions.where(F.col("file") == str(Path(first).resolve())).select("primary_key").limit(2).collect()
    return rows[0].primary_key if len(rows) == 1 else None


def key_owners(definitions: DataFrame) -> DataFrame:
    """(key_name, table_name): the table that defines each foreign key, names in lower case; the first file decides, and files with several tables say nothing."""
    alone = definitions.join(definitions.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n = 1"), "file", "left_semi")
    each = alone.select("file_order", "table_name", F.posexplode("keys").alias("place", "k")).select("file_order", "place", F.lower("k.name").alias("key_name"), "table_name")
    w = Window.partitionBy("key_name").orderBy("file_order", "place")
    return each.withColumn("n", F.row_number().over(w)).where("n = 1").select("key_name", "table_name")


def newer_references(files: list[str], table: str, since: float) -> bool:
    """Whether a file that changed since then, or any of changed tables, has a foreign key with an attribute equal to the table's name.

    Files that cannot be parsed, or have a document type, are passed over with a warning.
    """
    for f in files:
        if not is_changed_file(f) and Path(f).stat().st_mtime <= since:
            continue
        try:
            if has_doctype(f):
                raise ValueError("document type")
            keys = ElementTree.parse(f).iter("foreign-key")
            if any(v.lower() == table.lower() for key in keys for v in key.attrib.values()):
                return True
        except (ElementTree.ParseError, ValueError) as e:
            log.warning("%s is passed over: %s", f, e)
    return False


def properties(path: str) -> dict[str, str]:
    """Settings of a properties file: key = value or key: value, comments and backslashes left out."""
    out = {}
    for line in Path(path).read_text().splitlines():
        m = re.match(r"\s*([^#!=:\s][^=:\s]*)\s*[=:]\s*(.*?)\s*$", line)
        if m:
            out[m[1]] = m[2].replace("\\", "")
    return out


def connection(settings: dict[str, str]) -> dict[str, str]:
    """Options for spark.read.jdbc out of such settings; raises on a missing key, another system or another kind of address."""
    if settings.get("bbdd.rdbms", "POSTGRE").upper() != "POSTGRE":
        raise ValueError(f"not a PostgreSQL system: {settings['bbdd.rdbms']}")
    url = settings["bbdd.url"]
    m = re.fullmatch(r"jdbc:postgresql://([^:/]+):(\d+)", url)
    if not m:
        raise ValueError(f"not a PostgreSQL address: {url}")
    return {"url": f"{url}/{settings['bbdd.sid']}", "host": m[1], "port": m[2], "user": settings["bbdd.user"], "password": settings["bbdd.password"]}
