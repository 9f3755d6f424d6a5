"""CSV files, profiles, previews and document folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.sources.csvsplit import read_split_csv

PREVIEW_DEFAULT = 10
PREVIEW_MAX = 100

_TEXT_KEPT = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# Stands for a field without text while a file is parsed; no text file holds it.
_NO_TEXT = "\u0000"

# The fields of a document name per kind; the extension comes last.
DOCUMENT_FIELDS = {
    "statement": ("prefix", "contract_number", "payment_date", "transform_subtype"),
    "invoice": (
        "prefix", "contract_number", "partner_contract", "currency", "payment_date", "transform_subtype",
    ),
    "gl": ("gl_document_type", "financial_institution", "gl_posting_date"),
}


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: str | T.StructType | None = None,
    sep: str = ",",
    header: bool = True,
    corrupt_column: str | None = None,
    multiline: bool = False,
    encoding: str = "UTF-8",
    name_pattern: str | None = None,
    name_column: str | None = None,
) -> DataFrame:
    """A CSV side. Without a schema every column is text, so compares are exact.

    Blanks are kept; an empty field is NULL and a quoted empty one is empty text.
    ``multiline`` lets quoted fields hold line breaks. Files in UTF-8 stay splittable
    all the same (``csvsplit``); of other encodings a file is then read by one task.
    With ``corrupt_column`` (which the schema must name) unreadable lines are kept
    there instead of turning into NULLs unseen. ``name_pattern`` picks files by name,
    and ``name_column`` adds the name of a row's file.
    """
    options = {"sep": sep, "mode": "PERMISSIVE", "nullValue": _NO_TEXT, "emptyValue": "", "multiLine": str(multiline).lower()}
    options |= {name: str(value).lower() if isinstance(value, bool) else value for name, value in _TEXT_KEPT.items()}
    if corrupt_column:
        options["columnNameOfCorruptRecord"] = corrupt_column
    reader = spark.read.options(**options).option("header", header).option("encoding", encoding)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.csv(path)
    if multiline and encoding.upper().replace("-", "") == "UTF8":
        found = read_split_csv(spark, path, rows.schema, options, sep, header, name_pattern)
        return found.withColumnRenamed("_name", name_column) if name_column else found.drop("_name")
    return rows.select("*", F.col("_metadata.file_name").alias(name_column)) if name_column else rows


def export_csv(
    df: DataFrame,
    path: str,
    order_by: Sequence[str] = (),
    limit: int | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
) -> str:
    """Write ``df`` as CSV with a header per file; ``order_by`` sorts across files.

    Blanks are kept, NULL is an empty field, and empty text a quoted one.
    """
    if order_by:
        df = df.orderBy(*order_by)
    if limit is not None:
        df = df.limit(limit)
    writer = df.write.option("header", True).option("sep", sep).option("encoding", encoding)
    writer.options(**_TEXT_KEPT).option("nullValue", "").option("emptyValue", '""').csv(path)
    return path


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, NULLs and value range, in a single pass."""
    cells = []
    for i, f in enumerate(df.schema.fields):
        plain = isinstance(f.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
        low, high = (F.min(f.name), F.max(f.name)) if plain else (F.lit(None), F.lit(None))
        cells.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("column_type"),
                F.count("*").alias("row_count"),
                (F.count("*") - F.count(F.col(f.name))).alias("null_count"),
                low.cast("string").alias("min_value"),
                high.cast("string").alias("max_value"),
            )
        )
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns and column names."""
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(", ".join(df.columns)).alias("column_names"),
    )


def file_sizes(df: DataFrame) -> DataFrame:
    """Path and size of the files behind a file-based ``df``, read from metadata."""
    return df.select("_metadata.file_path", "_metadata.file_size").distinct()


def preview(df: DataFrame, keys: Sequence[str], n: int = PREVIEW_DEFAULT) -> DataFrame:
    """The first ``n`` rows in key order; more than 100 are an error, not a shorter preview."""
    if n > PREVIEW_MAX:
        raise ValueError(f"a preview has at most {PREVIEW_MAX} rows, not {n}")
    return df.orderBy(*keys).limit(n)


def document_key(kind: str, **fields: Column) -> Column:
    """The document name of a kind, built from its fields and ``extension``."""
    names = (*_fields(kind), "extension")
    absent = [n for n in names if n not in fields]
    if absent:
        raise ValueError(f"{kind} needs {absent}")
    return F.concat_ws(".", *[fields[n] for n in names])


def _fields(kind: str) -> tuple[str, ...]:
    if kind not in DOCUMENT_FIELDS:
        raise ValueError(f"unknown document kind {kind!r}; known: {sorted(DOCUMENT_FIELDS)}")
    return DOCUMENT_FIELDS[kind]


def document_pattern(kind: str, **fields: str) -> str:
    """A file-name glob; fields not given match anything."""
    return ".".join(fields.get(n, "*") for n in (*_fields(kind), "extension"))


def document_fields(kind: str, file_name: Column) -> list[Column]:
    """The fields of a document read back from its file name."""
    parts = F.split(file_name, r"\.")
    return [parts[i].alias(n) for i, n in enumerate((*_fields(kind), "extension"))]


def read_documents(
    spark: SparkSession, root: str, kind: str, sep: str = ",", multiline: bool = False, **fields: str
) -> DataFrame:
    """CSV documents of a kind under ``root``, each row with its document's fields."""
    pattern = document_pattern(kind, **fields)
    rows = read_csv(spark, root, sep=sep, multiline=multiline, name_pattern=pattern, name_column="_name")
    return rows.select("*", *document_fields(kind, F.col("_name"))).drop("_name")


def write_documents(df: DataFrame, root: str, kind: str, sep: str = ",", **fields: Column) -> str:
    """Write ``df`` as CSV documents below ``root``, one file for each value of the kind's fields.

    A document is one file, so its rows are one task's work. Spark names the files that it writes; they are renamed
    when all are there, one metadata call each.
    """
    spark = df.sparkSession
    named = df.withColumn("_document", document_key(kind, **fields))
    parts = f"{root.rstrip('/')}/_parts"
    columns = [c for c in named.columns if c != "_document"]
    writer = named.select(*columns, "_document").repartition("_document").write.partitionBy("_document")
    writer.option("header", True).option("sep", sep).options(**_TEXT_KEPT).option("nullValue", "").option("emptyValue", '""').csv(parts)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    top = hadoop(parts)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    unescaped = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for folder in system.listStatus(top):
        if folder.isDirectory():
            document = unescaped(folder.getPath().getName().split("=", 1)[1])
            for part in system.listStatus(folder.getPath()):
                if not system.rename(part.getPath(), hadoop(root, document)):
                    raise OSError(f"could not name document {document!r}")
    system.delete(top, True)
    return root


def list_documents(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Path, size and time of files; their content is not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
        .load(root)
        .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    )
