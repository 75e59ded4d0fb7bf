"""Files: Parquet, CSV with semicolons, JSON and binary files, through Spark's readers and writers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, folder: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A table of the folder, with the given columns in the given order."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns is not None else df


def register_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Temporary views by the tables' names, for SQL."""
    for name in names:
        read_table(spark, folder, name).createOrReplaceTempView(name)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, sep: str = ";") -> DataFrame:
    """Lines of fields between semicolons; a field with a separator is quoted, a quote in it doubled."""
    return spark.read.csv(path, schema=schema, sep=sep, quote='"', escape='"', header=header, mode="PERMISSIVE")


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ";") -> None:
    """Fields between semicolons, lines ended by CR LF; quotes only where a field holds the separator or a quote."""
    df.write.mode("overwrite").csv(path, sep=sep, quote='"', escape='"', header=header, lineSep="\r\n", emptyValue="")


def write_json_lines(df: DataFrame, path: str, columns: dict[str, str] | None = None) -> None:
    """Mapped columns only (column: name in the object), nulls written out."""
    chosen = df.select(*[F.col(c).alias(n) for c, n in columns.items()]) if columns else df
    chosen.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_json_objects(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of files of any Hadoop file system."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def changed_files(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Files (binary-file rows) of `theirs` that `ours` lacks or holds with other content, by name and SHA-256: what a mirror has to copy."""
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    digest = F.sha2("content", 256)
    mine = ours.select(name, digest.alias("our_digest"))
    return theirs.select(name, "path", "length", digest.alias("digest")).join(mine, "name", "left").where(~F.col("digest").eqNullSafe(F.col("our_digest"))).select("name", "path", "length", "digest")


def append(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table_name, column_name, data_type, nullable) of the catalog's tables and views: information about the schema, not the data."""
    rows = [(t.name, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean")
