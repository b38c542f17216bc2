"""Schema files: one table a line, ``TABLE|COL:TYPE[:LEN]|...``."""

from __future__ import annotations

from pyspark.sql import types as T

#: A DATE column holds a yyyymmdd number.
TYPES = {"INTEGER": T.IntegerType(), "DATE": T.IntegerType(), "DECIMAL": T.DecimalType(18, 2), "TEXT": T.StringType()}


class SchemaError(ValueError):
    pass


def parse_schema(text: str) -> dict[str, T.StructType]:
    """Table name to columns, names in upper case; a TEXT column keeps its length in the metadata."""
    tables: dict[str, T.StructType] = {}
    for line in filter(None, map(str.strip, text.splitlines())):
        name, *columns = line.rstrip("|").split("|")
        fields = []
        for column in columns:
            if ":" not in column:  # not a column definition
                continue
            col, kind, *length = (x.strip() for x in column.split(":"))
            if kind.upper() not in TYPES:
                raise SchemaError(f"{name}.{col}: unknown type {kind}")
            metadata = {"kind": kind.upper()} | ({"length": int(length[0])} if length and length[0] else {})
            fields.append(T.StructField(col.upper(), TYPES[kind.upper()], True, metadata))
        tables[name.strip().upper()] = T.StructType(fields)
    return tables


def format_schema(tables: dict[str, T.StructType]) -> str:
    """The inverse of ``parse_schema``."""
    lines = []
    for name, struct in tables.items():
        cols = []
        for f in struct.fields:
            kind = f.metadata.get("kind") or next(k for k, t in TYPES.items() if type(t) is type(f.dataType))
            cols.append(f"{f.name}:{kind}" + (f":{f.metadata['length']}" if "length" in f.metadata else ""))
        lines.append("|".join([name, *cols]))
    return "\n".join(lines) + "\n"
