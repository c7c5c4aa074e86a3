"""Readers and writers: dict-per-line records, tables with NA, reference lists, result tables in many text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _literal(lines):
    """Dict literals that JSON can't read; null for anything that is no dict."""
    import ast

    def one(line):
        try:
            value = ast.literal_eval(line)
            return {str(k): str(v) for k, v in value.items()} if isinstance(value, dict) else None
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return lines.map(one, na_action="ignore")


def parsed_entries(lines: DataFrame) -> DataFrame:
    """``lines`` (line, further columns) with ``entry``, the line's dict as a map, and ``bad``; only lines that JSON can't read go through Python."""
    parsed = lines.withColumn("entry", F.from_json("line", "map<string,string>", {"allowSingleQuotes": "true"}))
    fast = parsed.where(F.col("entry").isNotNull())
    slow = parsed.where(F.col("entry").isNull()).withColumn("entry", _literal("line"))
    return fast.unionByName(slow).withColumn("bad", F.col("entry").isNull())


def read_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, entry, bad): one dict per line as a map."""
    return parsed_entries(spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "line"))


def widened(df: DataFrame, entry: str, keys: list[str] | None = None, most: int = 1000, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and one column per key; without a list, of all keys that occur, sorted.  Raises beyond ``most`` of them."""
    if keys is None:
        found = df.select(F.explode(F.map_keys(entry)).alias("k")).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} keys")
        keys = sorted(r["k"] for r in found)
    return df.select(*(keep or []), *[F.element_at(entry, k).alias(k) for k in keys])


def write_table(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.option("sep", "\t").option("header", header).csv(path)


def write_entries(df: DataFrame, entry: str, path: str) -> None:
    df.select(F.to_json(entry)).write.text(path)


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """Delimited text with NA as null; blank numbers are null, blank text stays blank."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("nullValue", "NA").option("emptyValue", "").csv(path)


def read_texts(spark: SparkSession, path: str, columns: list[str], sep: str = "\t", header: bool = True) -> DataFrame:
    """All columns as text, so that trailing zeros stay."""
    return read_table(spark, path, ", ".join(f"`{c}` string" for c in columns), sep, header)


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(bib_id, kind, fields, bad, place) of a BibTeX file, one row per reference; both ``key={v}`` and ``key = {v}``.

    Of a repeated field the last value holds.  Of a repeated id every row stays; ``last_reference`` picks one.  ``place``
    rises along the file.  Columns from folders' names (``order1=...``) stay.
    """
    raw = spark.read.option("lineSep", "\n}").text(path).where(F.col("value").contains("@")).withColumn("place", F.monotonically_increasing_id())
    field = r"(?m)^\s*([\w-]+)\s*=\s*\{(.*)\}"
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(field), 1).alias("k"), F.regexp_extract_all("value", F.lit(field), 2).alias("v"))
    last = F.transform(F.array_distinct(F.regexp_extract_all("value", F.lit(field), 1)), lambda k: F.struct(k, F.element_at(F.filter("_pairs", lambda p: p["k"] == k), -1)["v"]))
    head = r"@(\w+)\s*\{\s*([^,\s]*)\s*,"
    folders = [c for c in raw.columns if c not in ("value", "place")]
    out = raw.withColumn("_pairs", pairs).select(*folders, F.regexp_extract("value", head, 2).alias("bib_id"), F.regexp_extract("value", head, 1).alias("kind"), F.map_from_entries(last).alias("fields"), "place")
    return out.withColumn("bad", (F.col("bib_id") == "") | (F.size("fields") == 0))


def last_reference(references: DataFrame, keys: tuple[str, ...] = ("bib_id",)) -> DataFrame:
    """Of each id (or keys) the reference that comes last in its file."""
    rest = [c for c in references.columns if c not in keys]
    return references.groupBy(*keys).agg(F.max_by(F.struct(*rest), "place").alias("_r")).select(*keys, "_r.*")


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """(bib_id, comment) of a list with optional ``id : #comment`` lines."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.trim(F.regexp_extract("value", r"^([^:#]*)", 1)).alias("bib_id"), F.nullif(F.regexp_extract("value", r"#\s*(.*)$", 1), F.lit("")).alias("comment"))


def read_by_order(spark: SparkSession, glob: str, pattern: str, name: str = "order1") -> DataFrame:
    """(name, line): lines of many files, blank ones left out, with a key from each file's path; blank where the path has none."""
    return spark.read.text(glob).where(F.trim("value") != "").select(F.regexp_extract("_metadata.file_path", pattern, 1).alias(name), F.col("value").alias("line"))


def read_results(spark: SparkSession, glob: str, models: list[str], name_pattern: str) -> DataFrame:
    """(analysis, model, value): the number that ends each of the lines after the first."""
    whole = spark.read.text(glob, wholetext=True).select(F.regexp_extract("_metadata.file_path", name_pattern, 1).alias("analysis"), F.split("value", "\n").alias("l"))
    rows = whole.select("analysis", F.posexplode(F.slice("l", 2, len(models))).alias("i", "line"))
    return rows.select("analysis", F.element_at(F.array(*map(F.lit, models)), F.col("i") + 1).alias("model"), F.regexp_extract("line", r"(-*[0-9]+\.*[0-9]*)\s*$", 1).try_cast("double").alias("value"))


def read_replicates(spark: SparkSession, glob: str, schema: str, pattern: str) -> DataFrame:
    """Rows of many delimited files with the replicate from each file's path."""
    rows = spark.read.schema(schema).option("header", True).option("sep", "\t").option("nullValue", "NA").csv(glob)
    return rows.withColumn("replicate", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
