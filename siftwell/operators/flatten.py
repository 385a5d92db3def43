"""Nested values as arrays of leaves, one row a document.

A leaf is (path, leaf, depth, kind, text, num, date, vkey): ``kind`` is text, number or date,
``text`` what is searched for words. Flattening is narrow: each document keeps its leaves in
one array column, so that questions about a document need no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions import text as X

RAW = "array<struct<path:string,depth:int,kind:string,text:string,num:double>>"
_RAW_TYPE = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("num", T.DoubleType())]))


def _leaf(path: Column, depth: int, kind: str, text: Column | None = None, num: Column | None = None) -> Column:
    s = F.struct(path.alias("path"), F.lit(depth).alias("depth"), F.lit(kind).alias("kind"), (text if text is not None else F.lit(None)).cast("string").alias("text"), (num if num is not None else F.lit(None)).cast("double").alias("num"))
    return F.array(s).cast(RAW)


def typed_leaves(c: Column, kind: T.DataType, path: Column, depth: int, dates: bool = True) -> Column:
    """Raw leaves of a column of any type: arrays by position, maps and structs by key, dates as Y-M-D.

    Booleans are text; a null is the text "null", as in a JSON document.
    """
    null = _leaf(path, depth, "text", F.lit("null"))
    under = lambda key: F.concat(path, F.lit("."), key)
    if isinstance(kind, T.StructType):
        parts = [typed_leaves(c.getField(f.name), f.dataType, under(F.lit(f.name)), depth + 1, dates) for f in kind.fields]
        return F.when(c.isNull(), null).otherwise(F.flatten(F.array(*parts)) if parts else F.array().cast(RAW))
    if isinstance(kind, T.ArrayType):
        return F.when(c.isNull(), null).otherwise(F.flatten(F.transform(c, lambda x, i: typed_leaves(x, kind.elementType, under(i.cast("string")), depth + 1, dates))))
    if isinstance(kind, T.MapType):
        return F.when(c.isNull(), null).otherwise(F.flatten(F.transform(F.map_entries(c), lambda e: typed_leaves(e["value"], kind.valueType, under(e["key"].cast("string")), depth + 1, dates))))
    if isinstance(kind, T.NumericType):
        got = _leaf(path, depth, "number", num=c)
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) and dates:
        got = _leaf(path, depth, "date", F.date_format(c, "yyyy-MM-dd"))
    else:
        got = _leaf(path, depth, "text", c.cast("string"))
    return F.when(c.isNull(), null).otherwise(got)


def finished(raw: Column, max_depth: int | None = None) -> Column:
    """Leaves from raw ones: values normalized, search text and keys filled in, deeper ones left out.

    With ``max_depth``, leaves at depths up to it are kept, but only those above it are normalized.
    """
    if max_depth is not None:
        raw = F.filter(raw, lambda x: x["depth"] <= max_depth)

    def one(x: Column) -> Column:
        inner = F.lit(True) if max_depth is None else x["depth"] < max_depth
        date = F.when(x["kind"] == "date", F.when(inner, X.normalize_date(x["text"])).otherwise(x["text"]))
        text = F.when(x["kind"] == "number", X.number_text(x["num"])).when(x["kind"] == "date", date).when(inner, X.normalize_text(x["text"])).otherwise(x["text"])
        key = F.when(x["kind"] == "number", X.value_key(x["num"])).when(x["kind"] == "date", X.date_key(date))
        return F.struct(x["path"].alias("path"), X.leaf(x["path"]).alias("leaf"), x["depth"].alias("depth"), x["kind"].alias("kind"), text.alias("text"), x["num"].alias("num"), date.alias("date"), key.alias("vkey"))

    return F.transform(raw, one)


LEAF = "struct<path:string,leaf:string,depth:int,kind:string,text:string,num:double,date:string,vkey:bigint>"
LEAVES = f"array<{LEAF}>"


@dataclass(frozen=True)
class Field:
    """A root field with one value a document, held in a column of its own: its path is part of the plan."""

    path: str
    kind: str  # text, number or date
    column: str
    type: T.DataType

    @property
    def value(self) -> Column:
        return F.col(self.column)

    @property
    def leaf(self) -> str:
        return self.path.rpartition(".")[2]

    @property
    def integral(self) -> bool:
        return isinstance(self.type, T.IntegralType)

    @property
    def searched(self) -> Column:
        """What is searched for words."""
        if self.kind == "date":
            return F.date_format(self.value, "yyyy-MM-dd")
        if self.kind == "number" and not self.integral:
            return X.number_text(self.value)
        return self.value.cast("string")

    @property
    def vkey(self) -> Column:
        if self.kind == "date":
            d = self.value
            return (F.year(d) * 10000 + F.month(d) * 100 + F.day(d)).cast("long")
        return X.value_key(self.value) if self.kind == "number" else F.lit(None).cast("long")

    def as_leaf(self, normal: bool = True) -> Column:
        text = X.normalize_text(self.searched) if self.kind == "text" and normal else self.searched
        none = F.lit(None)
        s = F.struct(
            F.lit(self.path).alias("path"), F.lit(self.leaf).alias("leaf"), F.lit(0).alias("depth"), F.lit(self.kind).alias("kind"), text.alias("text"),
            (self.value if self.kind == "number" else none).cast("double").alias("num"), (text if self.kind == "date" else none).cast("string").alias("date"), self.vkey.alias("vkey"),
        )
        return F.when(self.value.isNotNull(), s.cast(LEAF))


def table_fields(df: DataFrame, id_col: str, fields: list[str] | None = None, max_depth: int | None = None) -> tuple[DataFrame, list[Field]]:
    """A table whose rows are documents and whose columns are the root's fields: (doc_id, a column for each plain field, leaves), fields.

    ``leaves`` are those of arrays, maps and structs. Absent values (null columns) have no leaf; nulls
    inside arrays and structs are the text "null".
    """
    plain, cols, nested = [], [], []
    for i, c in enumerate(fields if fields is not None else [c for c in df.columns if c != id_col]):
        kind, col = df.schema[c].dataType, df[f"`{c}`"]
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            nested.append(F.when(col.isNull(), F.array().cast(RAW)).otherwise(typed_leaves(col, kind, F.lit(c), 0)))
            continue
        what = "number" if isinstance(kind, T.NumericType) else "date" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"
        plain.append(Field(c, what, f"field_{i}", kind))
        cols.append(col.alias(f"field_{i}"))
    leaves = finished(F.flatten(F.array(*nested)), max_depth) if nested else F.array()
    return df.select(df[f"`{id_col}`"].alias("doc_id"), *cols, leaves.cast(LEAVES).alias("leaves")), plain


def _walk(doc: dict, dates: frozenset[str], out: list) -> None:
    """The leaves of a document in order, without recursion."""
    todo = [(str(k), 0, v) for k, v in reversed(doc.items())]
    while todo:
        path, depth, value = todo.pop()
        if isinstance(value, (dict, list)):
            items = list(value.items() if isinstance(value, dict) else enumerate(value))
            # an empty key at the root leaves no dot, as an empty parent has none
            todo += [(f"{path}.{k}" if path else str(k), depth + 1, v) for k, v in reversed(items)]
        elif isinstance(value, bool) or value is None or isinstance(value, str):
            s = value if isinstance(value, str) else "null" if value is None else str(value).lower()
            out.append({"path": path, "depth": depth, "kind": "date" if path in dates and isinstance(value, str) else "text", "text": s, "num": None})
        else:
            try:
                num = float(value)
            except OverflowError:
                num = float("inf") if value > 0 else float("-inf")
            out.append({"path": path, "depth": depth, "kind": "number", "text": None, "num": num})


def _object(s: str | None) -> dict | None:
    """The JSON object of a text, or None; what is nested deeper than the parser follows is none."""
    try:
        doc = json.loads(s) if s is not None else None
    except (ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


def json_leaves(df: DataFrame, id_col: str, json_col: str, max_depth: int | None = None, date_paths: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, leaves) of JSON objects in a string column; one pass in Arrow batches.

    Types may differ from document to document under one path. Of repeated keys the last counts. What is
    no JSON object (null, broken text, a scalar, thousands of levels that the parser can't follow) has no leaves. ``date_paths`` are dates.
    """
    dates = frozenset(date_paths)
    src = df.select(df[f"`{id_col}`"].alias("doc_id"), df[f"`{json_col}`"].alias("data"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("raw", _RAW_TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s in b.column(1).to_pylist():
                out: list = []
                _walk(_object(s) or {}, dates, out)
                rows.append(out)
            item = pa.struct([("path", pa.string()), ("depth", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("num", pa.float64())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(item))], names=["doc_id", "raw"])

    return src.mapInArrow(run, schema).select("doc_id", finished(F.col("raw"), max_depth).alias("leaves"))


def invalid_keys(value: object) -> bool:
    """Whether a document has an empty field name anywhere."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if any(not str(k) for k in v):
                return True
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return False


@F.pandas_udf(T.BooleanType())
def valid_json(data: pd.Series) -> pd.Series:
    """Whether a text is a JSON object without an empty field name, at any level."""
    found = [_object(s) for s in data]
    return pd.Series([d is not None and not invalid_keys(d) for d in found])
