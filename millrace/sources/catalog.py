"""A shell's view of databases: create, delete, list, restore, load, help."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .delimited import load_table
from .schema import format_schema, parse_schema

COMMANDS = {
    "create": "create NAME SCHEMA_FILE_TEXT: declare a database's tables",
    "delete": "delete NAME: remove a database, its tables and its views",
    "list": "list: names of the databases",
    "restore": "restore NAME: register a database's loaded tables as views again",
    "load": "load NAME TABLE PATH: text file into the table's Parquet folder",
    "help": "help: this text",
}


class Catalog:
    """Databases under one folder that Spark can reach; each keeps its schema file as text beside its tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.databases: dict[str, dict[str, T.StructType]] = {}

    def _at(self, *names: str):
        """(file system, path) of something under the root, wherever Spark can reach it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _stored(self, name: str) -> bool:
        fs, path = self._at(name, "_schema_file")
        return fs.exists(path)

    def create(self, name: str, schema_text: str) -> None:
        if name in self.databases or self._stored(name):
            raise ValueError(f"database {name} exists")
        self.databases[name] = parse_schema(schema_text)
        lines = [(i, x) for i, x in enumerate(format_schema(self.databases[name]).splitlines())]
        self.spark.createDataFrame(lines, "i int, line string").coalesce(1).write.parquet(f"{self.root}/{name}/_schema_file")

    def load(self, name: str, table: str, path: str, sep: str = "|", sort_by: str | None = None) -> DataFrame:
        df = load_table(self.spark, self.databases[name], table, path, f"{self.root}/{name}/{table.upper()}", sep, sort_by)
        df.createOrReplaceTempView(table)
        return df

    def restore(self, name: str) -> list[str]:
        """Registers views of the tables that were loaded; their names."""
        rows = self.spark.read.parquet(f"{self.root}/{name}/_schema_file").orderBy("i").collect()  # one row a table
        self.databases[name] = parse_schema("\n".join(r["line"] for r in rows))
        found = []
        for table in self.databases[name]:
            try:
                df = self.spark.read.parquet(f"{self.root}/{name}/{table}")
            except Exception as e:  # not loaded yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            df.createOrReplaceTempView(table)
            found.append(table)
        return found

    def delete(self, name: str) -> None:
        if name not in self.databases and not self._stored(name):
            raise KeyError(name)
        for table in self.databases.pop(name, ()):
            self.spark.catalog.dropTempView(table)
        fs, path = self._at(name)
        fs.delete(path, True)

    def list(self) -> list[str]:
        """Databases of this session and those that others left under the root."""
        fs, path = self._at()
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted({*self.databases, *(n for n in found if self._stored(n))})

    def help(self) -> str:
        return "\n".join(COMMANDS.values())
