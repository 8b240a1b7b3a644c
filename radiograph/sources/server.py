"""A database server's catalog over JDBC: the rows that `operators.catalogs` reads, with filters that Spark pushes down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What is read: catalog tables and their columns, in the order of the arguments of the operators.
INFORMATION = {
    "tables": ("information_schema.tables", "table_schema, table_name, table_type"),
    "columns": ("information_schema.columns", "table_schema, table_name, column_name, ordinal_position, data_type, is_nullable"),
    "constraints": ("information_schema.table_constraints", "constraint_name, table_schema, table_name, constraint_type"),
    "referential": ("information_schema.referential_constraints", "constraint_name, constraint_schema, unique_constraint_name, unique_constraint_schema, update_rule, delete_rule"),
    "key_columns": ("information_schema.key_column_usage", "constraint_name, constraint_schema, table_schema, table_name, column_name, ordinal_position, position_in_unique_constraint"),
    "inherits": ("pg_catalog.pg_inherits", "inhrelid, inhparent"),
    "classes": ("pg_catalog.pg_class", "oid, relname, relkind, relispartition, relnamespace"),
    "namespaces": ("pg_catalog.pg_namespace", "oid, nspname"),
}


def read(spark: SparkSession, url: str, what: str, **options: str) -> DataFrame:
    """One of INFORMATION's tables of the server at a JDBC url; an error of the server is raised, not taken for an empty table."""
    table, columns = INFORMATION[what]
    return spark.read.format("jdbc").option("url", url).options(**options).option("query", f"select {columns} from {table}").load()


def catalog(spark: SparkSession, url: str, **options: str) -> dict[str, DataFrame]:
    """All of them."""
    return {what: read(spark, url, what, **options) for what in INFORMATION}
