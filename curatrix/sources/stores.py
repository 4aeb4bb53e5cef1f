"""Stores, registries and lists as files, read by Spark so that any shared path works."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators import numbering
from curatrix.sources import splitting

RECORD = "file_title string, `dct:title` string, `dcat:contactPoint` string, `dcat:keyword` string, `dct:publisher` string, `dcat:theme` string, `dct:type` string, `dct:language` string, `dct:issued` string, authors array<struct<name:string,affiliations:array<string>>>, `dct:relation` array<string>"
STAGED = RECORD + ", _status string, _error string, _aff_decisions array<struct<author:string,raw:string,matched_canonical:string,match_score:double,decision:string,new_canonical:string>>, _raw_affiliations map<string,array<string>>"


def _path(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _path(spark, path)
    return system.exists(place)


def empty(spark: SparkSession, path: str) -> None:
    """Removes a folder that is to be written anew."""
    place, system = _path(spark, path)
    system.delete(place, True)


def read_store(spark: SparkSession, path: str, schema: str = STAGED) -> DataFrame:
    """Records of a JSON array (or of JSON lines, as write_store leaves them), with ord; a missing file or other JSON gives none, items that are no objects go."""
    if not exists(spark, path) and exists(spark, f"{path}.old"):
        path = f"{path}.old"  # a writer was stopped between its two moves
    if not exists(spark, path):
        return spark.createDataFrame([], schema + ", ord long")
    if _path(spark, path)[1].isDirectory(_path(spark, path)[0]):
        return spark.read.schema(schema + ", ord long").json(path)
    rows = splitting.array_objects(spark, path)
    return rows.select(F.from_json("value", schema).alias("r"), "ord").select("r.*", "ord")


def write_store(records: DataFrame, path: str) -> None:
    """JSON lines in parts, written beside the target and moved there whole. Between the two moves the old store stands at .old, where read_store looks for it, so that a reader sees the old or the new store."""
    spark = records.sparkSession
    fresh, old = f"{path}.fresh", f"{path}.old"
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(fresh)
    place, system = _path(spark, path)
    beside, before = _path(spark, fresh)[0], _path(spark, old)[0]
    if system.exists(place):
        system.delete(before, True)
        system.rename(place, before)
    system.rename(beside, place)
    system.delete(before, True)


def write_stamped(records: DataFrame, folder: str, name: str, now: dt.datetime) -> str:
    """A store under a name with the minute of its writing."""
    path = f"{folder}/{name}_{now:%Y%m%d_%H%M}"
    write_store(records, path)
    return path


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, canon_ord, variant, var_ord) of a JSON map, or of what write_registry leaves; a canonical without variants has one row with null; a missing file gives none."""
    if not exists(spark, path) and exists(spark, f"{path}.old"):
        path = f"{path}.old"
    if exists(spark, path) and _path(spark, path)[1].isDirectory(_path(spark, path)[0]):
        lines = spark.read.schema("canonical string, variants array<string>, canon_ord int").json(path)
        return lines.select("canon_ord", "canonical", F.posexplode_outer("variants").alias("var_ord", "variant"))
    if not exists(spark, path):
        return spark.createDataFrame([], "canon_ord int, canonical string, var_ord int, variant string")
    entries = splitting.map_entries(spark, path).select(F.col("ord").cast("int").alias("canon_ord"), F.explode(F.map_entries(F.from_json("value", "map<string,array<string>>"))).alias("e"))
    return entries.select("canon_ord", F.col("e.key").alias("canonical"), F.posexplode_outer("e.value").alias("var_ord", "variant"))


def registry_rows(registry: DataFrame) -> DataFrame:
    """(canonical, variants): each variant once, in order of its first place."""
    firsts = registry.groupBy("canonical", "variant").agg(F.min("var_ord").alias("var_ord"))
    variants = F.transform(F.sort_array(F.collect_list(F.when(F.col("variant").isNotNull(), F.struct("var_ord", "variant")))), lambda x: x["variant"])
    return firsts.groupBy("canonical").agg(variants.alias("variants"))


def registry_json(registry: DataFrame) -> DataFrame:
    """One row per canonical (canonical, variants), in code point order and variants in theirs."""
    return registry_rows(registry).orderBy("canonical")


def write_registry(registry: DataFrame, path: str) -> None:
    """A registry (canonical, var_ord, variant) as lines in parts, canonicals numbered in code point order; replaced whole as a store is."""
    lines = numbering.numbered(registry_rows(registry), "canonical").withColumnRenamed("i", "canon_ord")
    write_store(lines.select("canonical", "variants", F.col("canon_ord").cast("int").alias("canon_ord")), path)


def migrate(spark: SparkSession, layout: dict[str, str], legacy: dict[str, str]) -> dict[str, str]:
    """Brings a dataset to its layout, once: what exists is skipped, what an older layout has is converted, the rest starts empty.

    Both name paths of records, staged and registry; an older registry is a group file. Tells of each what was done."""
    done = {}
    for name, path in layout.items():
        old = legacy.get(name)
        if exists(spark, path) or exists(spark, f"{path}.old"):
            done[name] = "skipped"
        elif name == "registry":
            found = bool(old) and exists(spark, old)
            groups = migrated(read_groups(spark, old)) if found else spark.createDataFrame([], "canonical string, var_ord int, variant string")
            write_registry(groups, path)
            done[name] = "converted" if found else "started empty"
        else:
            found = name != "staged" and bool(old) and exists(spark, old)
            write_store(read_store(spark, old) if found else spark.createDataFrame([], STAGED + ", ord long"), path)
            done[name] = "converted" if found else "started empty"
    return done


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, group_ord, variant, ord) of a group file: canonical to a list of maps of a variant and its count."""
    groups = splitting.map_entries(spark, path).select(F.col("ord").cast("int").alias("group_ord"), F.explode(F.map_entries(F.from_json("value", "map<string,array<map<string,int>>>"))).alias("e"))
    names = F.flatten(F.transform("e.value", F.map_keys))
    return groups.select("group_ord", F.col("e.key").alias("canonical"), F.posexplode_outer(names).alias("ord", "variant"))


def variant_map(groups: DataFrame) -> DataFrame:
    """(variant, canonical), both stripped; of repeated variants the last group's canonical holds."""
    rows = groups.where("variant is not null").select(F.trim("variant").alias("variant"), F.trim("canonical").alias("canonical"), F.struct("group_ord", "ord").alias("at"))
    return rows.groupBy("variant").agg(F.max_by("canonical", "at").alias("canonical"))


def migrated(groups: DataFrame) -> DataFrame:
    """A registry from groups; a canonical is no variant of itself."""
    own = F.when(F.col("variant") != F.col("canonical"), F.col("variant"))
    return groups.select(F.col("group_ord").alias("canon_ord"), "canonical", F.col("ord").alias("var_ord"), own.alias("variant"))


def read_organisations(spark: SparkSession, path: str, name: str, address: str) -> DataFrame:
    """(key, name, address) of a tab-separated list with trimmed headers; a missing file gives none; of repeated keys the last holds."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, name string, address string")
    lines = splitting.pieces(spark, path, "\n").withColumn("line", F.regexp_replace("value", "\r$", "")).where("trim(line) <> ''")
    header = lines.where("block = 0").orderBy("at").first()
    names = [c.strip() for c in header.line.split("\t")] if header else []
    cell = lambda column: F.trim(F.coalesce(F.try_element_at(F.split("line", "\t"), F.lit(names.index(column) + 1)), F.lit("")))
    body = lines.where((F.col("block") > 0) | (F.col("at") > (header["at"] if header else 0)))
    rows = body.select(F.lower(cell(name)).alias("key"), cell(name).alias("name"), cell(address).alias("address"), F.struct("block", "at").alias("order"))
    return rows.where("key <> ''").groupBy("key").agg(F.max_by(F.struct("name", "address"), "order").alias("r")).select("key", "r.*")


def read_table(spark: SparkSession, path: str, dropped: tuple[str, ...] = ("file_title",)) -> DataFrame:
    """A workbook's sheet saved as CSV, all text, empty cells as empty strings, without some columns."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').na.fill("").drop(*dropped)


def write_table(df: DataFrame, path: str, loaded: list[str]) -> None:
    """CSV with the columns as they were loaded, new ones after them."""
    order = [c for c in loaded if c in df.columns] + [c for c in df.columns if c not in loaded]
    df.select(*[F.col(f"`{c}`") for c in order]).write.mode("overwrite").csv(path, header=True, escape='"')


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """(path, file_title, modificationTime, length) in order of names; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    title = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return found.select("path", title.alias("file_title"), "modificationTime", "length").orderBy("file_title", "path")


def to_copy(source: DataFrame, target: DataFrame) -> DataFrame:
    """Files of a listing that the target lacks or holds in an older state."""
    old = target.select("file_title", F.col("modificationTime").alias("had"))
    return source.join(old, "file_title", "left").where("had is null or modificationTime > had").drop("had")


def payload(entries: DataFrame) -> DataFrame:
    """One compact JSON text per entry, safe inside a script element."""
    return entries.select(F.replace(F.to_json(F.struct("*")), F.lit("</"), F.lit("<\\/")).alias("value"))


def without_cr(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def write_unmatched(names: DataFrame, column: str, path: str) -> None:
    """Distinct names in order, one a line."""
    names.select(F.col(column).alias("value")).where("value is not null").distinct().orderBy("value").write.mode("overwrite").text(path)
