"""Sources of a capture study: text tables, record files, experiment trees, logs, images, catalogs."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import composite_id, label_bag_time, label_global, label_header_stamp
from ..operators.rollup import first_row


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every cell a string; an empty cell is an empty string."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True).na.fill("")


def read_csv_keyed(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """A CSV table keyed by ``id``, or by dataset and sequence where it has no id."""
    rows = read_csv(spark, path)
    own = F.nullif(F.col("id"), F.lit("")) if "id" in rows.columns else None
    parts = composite_id(F.col("dataset"), F.col("sequence_id")) if "dataset" in rows.columns else None
    key = F.coalesce(*[c for c in (own, parts) if c is not None])
    return rows.select(key.alias("key"), *[F.col(c).alias(f"{prefix}{c}") for c in rows.columns])


def read_records(spark: SparkSession, path: str, schema: str | StructType, key_pattern: str) -> DataFrame:
    """One JSON record per file, with the key that the file's path carries."""
    return (
        spark.read.schema(schema).json(path, multiLine=True)
        .withColumn("key", F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1))
    )


def with_records(keys: DataFrame, records: DataFrame) -> DataFrame:
    """Every key with its record; an absent file is a null record."""
    return keys.join(records, "key", "left")


def path_keys(pattern: str, names: Sequence[str]) -> dict[str, Column]:
    """Columns taken from the groups of a pattern over the file path."""
    return {n: F.regexp_extract(F.col("_metadata.file_path"), pattern, i + 1) for i, n in enumerate(names)}


def read_tree(spark: SparkSession, path: str, schema: str | StructType, pattern: str, names: Sequence[str]) -> DataFrame:
    """JSON files of an experiment tree, with the keys their directories are named after."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.json"
    ).json(path, multiLine=True).withColumns(path_keys(pattern, names))


def conditions_with_seeds(conditions: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per seed, and one for a condition without seeds."""
    return conditions.join(seeds, list(keys), "left")


def first_named(files: DataFrame, keys: Sequence[str], rank: Column, path: str) -> DataFrame:
    """The file of each key that comes first: by rank, then by path."""
    return first_row(files, keys, [rank, F.col(path)])


def read_frame_list(spark: SparkSession, path: str) -> DataFrame:
    """Frame lists: ``file, name, label`` and what the label says of position and time."""
    rows = spark.read.csv(path, sep="\t", schema="name string, label string", quote="")
    label = F.col("label")
    return rows.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("seq_id"), "name", "label",
        label_global(label).alias("global_index"), label_bag_time(label).alias("bag_time"),
        label_header_stamp(label).alias("header_stamp"),
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as rasters: ``path, h, w, channels, grey, bgr``; a file that cannot be read stays
    as a row without size and raster."""
    images = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")

    def rasters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for origin, h, w, c, data in zip(pdf.origin, pdf.height, pdf.width, pdf.nChannels, pdf.data):
                if h <= 0 or w <= 0 or c <= 0:
                    rows.append((origin, None, None, None, None, None))
                    continue
                px = np.frombuffer(data, np.uint8).reshape(h, w, c)
                grey = px[..., 0] if c == 1 else np.rint(px[..., :3].astype(float) @ (0.114, 0.587, 0.299))
                rows.append((origin, h, w, c, grey.ravel().astype("float32"), px.ravel().astype("float32")))
            yield pd.DataFrame(rows, columns=["path", "h", "w", "channels", "grey", "bgr"]).astype(
                {"h": "Int32", "w": "Int32", "channels": "Int32"})

    return images.mapInPandas(
        rasters, "path string, h int, w int, channels int, grey array<float>, bgr array<float>"
    )


def write_log(messages: DataFrame, path: str, t: str, bucket: float) -> None:
    """A message log partitioned by time bucket, the layout ``scan_window`` prunes."""
    messages.withColumn("bucket", F.floor(F.col(t) / bucket).cast("bigint")).write.mode(
        "overwrite"
    ).partitionBy("bucket").parquet(path)


def scan_window(spark: SparkSession, path: str, t: str, t0: float, t1: float, bucket: float) -> DataFrame:
    """Messages with time in the closed window; only its buckets are read."""
    low, high = int(t0 // bucket), int(t1 // bucket)
    return (
        spark.read.parquet(path).where(F.col("bucket").between(low, high))
        .where(F.col(t).between(t0, t1)).drop("bucket")
    )


def sample_by_mark(messages: DataFrame, topic: str, t: str, step: float, order: Sequence[str]) -> DataFrame:
    """First message of each topic at or after each mark; marks lie ``step`` apart from the start."""
    start = messages.agg(F.min(t).alias("_t0"))
    marked = messages.crossJoin(F.broadcast(start))  # one row
    mark = F.floor((F.col(t) - F.col("_t0")) / step).cast("bigint")
    return first_row(marked.withColumn("mark", mark).drop("_t0"), [topic, "mark"], [F.col(c) for c in order])


CATALOG_SCHEMA = (
    "name string, paper_number string, caption string, columns array<string>, rows array<array<string>>, "
    "row_ids array<string>, row_classes array<string>, row_groups array<string>, "
    "row_links array<array<struct<key:string,kind:string,url:string>>>, column_names map<string,string>, "
    "notes array<string>"
)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_SCHEMA).json(path, multiLine=True)


def catalog_long(catalog: DataFrame) -> DataFrame:
    """Catalog tables as one row per cell: ``name, index, id, class, group, column, cell``."""
    rows = catalog.select("*", F.posexplode("rows").alias("index", "_cells"))
    at = lambda c: F.get(F.col(c), F.col("index"))
    flat = rows.select(
        "name", "index", at("row_ids").alias("id"), at("row_classes").alias("class"),
        at("row_groups").alias("group"), F.posexplode(F.arrays_zip("columns", "_cells")).alias("place", "_c"),
    )
    return flat.select("name", "index", "id", "class", "group", "place", F.col("_c.columns").alias("column"), F.col("_c._cells").alias("cell"))


ENTRY_HEAD = re.compile(r"@(\w+)\s*\{")  # the file format: a type and an opening brace
RECORDS = "array<struct<key:string,type:string,fields:array<struct<name:string,value:string>>>>"


def top_level(text: str, start: int, marks: str) -> Iterator[tuple[int, str]]:
    """Places of the marks, and of the brace that closes the group, outside inner groups and quotes."""
    depth, quoted = 0, False
    for at in range(start, len(text)):
        c = text[at]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth < 0:
                yield at, c
                return
        elif c == '"' and depth == 0:
            quoted = not quoted
        elif c in marks and depth == 0 and not quoted:
            yield at, c
    raise ValueError(f"a group that is not closed: {text[start:start + 80]}")


def plain_value(value: str) -> str:
    """A field's value without its own braces or quotes, white space as single spaces."""
    value = value.strip()
    if len(value) > 1 and (value[0], value[-1]) in (("{", "}"), ('"', '"')):
        value = value[1:-1]
    return " ".join(value.split())


def bibliography_records(text: str | None) -> list[tuple]:
    """The entries of one file; of a repeated field the last counts."""
    out, after = [], 0
    for head in ENTRY_HEAD.finditer(text or ""):
        if head.start() < after:
            continue
        start, parts = head.end(), []
        for at, _ in top_level(text, head.end(), ","):
            parts.append(text[start:at])
            start = at + 1
        after = start
        named = [p.partition("=") for p in parts[1:] if "=" in p]
        fields = {name.strip().lower(): plain_value(value) for name, _, value in named}
        out.append((parts[0].strip(), head[1].lower(), list(fields.items())))
    return out


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """Bibliography records: ``key, type, fields``; groups nest to any depth."""
    return bibliography(spark.read.text(path, wholetext=True), "value")


def bibliography(texts: DataFrame, column: str) -> DataFrame:
    parse = F.udf(bibliography_records, RECORDS, useArrow=True)
    rows = texts.select(F.explode(parse(F.col(column))).alias("_e"))
    return rows.select("_e.key", "_e.type", F.map_from_entries("_e.fields").alias("fields"))


HELD, BLANK = "\ue000", " \t\r\n"  # a stand-in for an escaped cell mark; white space


def without_options(parts: Column) -> Column:
    """What follows each command, without the option in square brackets it may have; the first part follows none."""
    def bare(part: Column, i: Column) -> Column:
        rest = F.ltrim(part, F.lit(BLANK))
        return F.when((i > 0) & F.startswith(rest, F.lit("[")), F.substr(rest, F.call_function("locate", F.lit("]"), rest) + 1)).otherwise(part)

    return F.transform(parts, bare)


def markup_rows(tables: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of a ruled markup table: ``key, group_no, row_no, cells``, header row as group 0.

    The body lies between the top and the bottom rule; middle rules part the groups. A row whose
    number of cells differs from the header's is an error.
    """
    top, bottom = F.lit("\\toprule"), F.lit("\\bottomrule")
    ruled = F.contains(F.col(text), top) & F.contains(F.col(text), bottom)
    body = F.substring_index(F.substring_index(F.col(text), "\\toprule", -1), "\\bottomrule", 1)
    groups = tables.where(ruled).select(key, F.posexplode(F.split(body, re.escape("\\midrule"))).alias("group_no", "_g"))
    lines = groups.select(key, "group_no", F.posexplode(without_options(F.split("_g", re.escape("\\\\")))).alias("_i", "_r"))
    clean = lines.withColumn("_r", F.array_join(without_options(F.split("_r", re.escape("\\addlinespace"))), ""))
    clean = clean.withColumn("_r", F.trim("_r", F.lit(BLANK))).where("_r <> ''")
    parted = F.split(F.replace("_r", F.lit("\\&"), F.lit(HELD)), "&")
    cells = clean.select(key, "group_no", F.col("_i").alias("row_no"), F.transform(
        parted, lambda c: F.trim(F.replace(c, F.lit(HELD), F.lit("\\&")), F.lit(BLANK))).alias("cells"))
    head = cells.where("group_no = 0").groupBy(key).agg(F.max(F.size("cells")).alias("_n"))
    wrong = F.raise_error(F.concat(F.lit("wrong number of cells: "), F.array_join("cells", " & ")))
    return cells.join(head, key).select(
        key, "group_no", "row_no", F.when(F.size("cells") == F.col("_n"), F.col("cells")).otherwise(wrong).alias("cells")
    )


def page_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """List items of raw pages as cells: ``key, place, cell``."""
    items = F.regexp_extract_all(html, F.lit(r"(?s)<li>(.*?)</li>"), 1)
    return pages.select(key, F.posexplode(items).alias("place", "_c")).select(
        key, "place", F.trim(F.regexp_replace("_c", r"<[^>]*>", "")).alias("cell")
    )

