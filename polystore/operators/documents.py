"""Documents: path extraction, a filter compiler, merging, sorting and paging.

A body is a struct column, whose paths are typed by the schema and pushed to the scan, or a VARIANT
column for collections without a schema. Filters are dictionaries of path: condition, all of which
must hold; a condition that is a dictionary names operators, anything else is equality. Missing and
null are the same; values of different kinds never match; booleans count as numbers.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, TEXT, LIST, OTHER = "number", "text", "list", "other"
NUMERIC = (T.NumericType, T.BooleanType)


class Field:
    """A path of a body: its value as a typed column."""

    def __init__(self, body: str, kind: T.DataType, path: str):
        self.body, self.path = body, path
        self.variant = isinstance(kind, T.VariantType)
        if not self.variant:
            self.value, self.kind = _walk(F.col(body), kind, path.split("."))

    def raw(self) -> Column:
        return variant_at(F.col(self.body), self.path)

    def shape(self) -> Column:
        """The kind of a variant's value: number, text, list, other; null for none."""
        said = F.schema_of_variant(self.raw())
        return (
            F.when(self.raw().isNull() | (said == "VOID"), F.lit(None))
            .when(said.isin("BIGINT", "DOUBLE", "BOOLEAN", "FLOAT") | said.startswith("DECIMAL"), F.lit(NUMBER))
            .when(said == "STRING", F.lit(TEXT))
            .when(said.startswith("ARRAY"), F.lit(LIST))
            .otherwise(F.lit(OTHER))
        )

    def number(self) -> Column:
        if self.variant:
            raw = self.raw()
            plain = F.when(F.schema_of_variant(raw) == "BOOLEAN", F.try_variant_get(raw, "$", "boolean").cast("double")).otherwise(F.try_variant_get(raw, "$", "double"))
            return F.when(self.shape() == NUMBER, plain)
        if isinstance(self.kind, T.BooleanType):
            return self.value.cast("int")
        return self.value if isinstance(self.kind, T.NumericType) else F.lit(None).cast("double")

    def text(self) -> Column:
        if self.variant:
            return F.when(self.shape() == TEXT, F.try_variant_get(self.raw(), "$", "string"))
        return self.value if isinstance(self.kind, T.StringType) else F.lit(None).cast("string")

    def items(self) -> tuple[Column, T.DataType] | None:
        if self.variant:
            return F.when(self.shape() == LIST, F.try_variant_get(self.raw(), "$", "array<variant>")), T.VariantType()
        return (self.value, self.kind.elementType) if isinstance(self.kind, T.ArrayType) else None

    def missing(self) -> Column:
        return self.shape().isNull() if self.variant else self.value.isNull()

    def sort_key(self) -> Column:
        """Numbers before texts; of variants, numbers by value and texts by bytes."""
        if not self.variant:
            return self.value
        return F.when(self.missing(), F.lit(None)).otherwise(F.struct(self.number().isNull().alias("t"), self.number().alias("n"), self.text().alias("s")))


def _walk(value: Column, kind: T.DataType, steps: list[str]) -> tuple[Column, T.DataType]:
    for step in steps:
        if isinstance(kind, T.StructType) and step in kind.names:
            value, kind = value.getField(step), kind[step].dataType
        elif isinstance(kind, T.MapType):
            value, kind = F.try_element_at(value, F.lit(step)), kind.valueType
        elif isinstance(kind, T.ArrayType) and step.lstrip("-").isdigit():
            at = int(step)
            value, kind = F.get(value, F.lit(at)) if at >= 0 else F.try_element_at(value, F.lit(at)), kind.elementType
        else:
            return F.lit(None), T.NullType()
    return value, kind


def _quoted(step: str) -> str:
    return step.replace("\\", "\\\\").replace("'", "\\'")


def variant_at(body: Column, path: str) -> Column:
    """The value at a dotted path of a variant; a number is a place of a list or a key of an object."""
    for step in path.split("."):
        named = F.try_variant_get(body, f"$['{_quoted(step)}']", "variant")
        if step.lstrip("-").isdigit():
            at = int(step)
            placed = F.try_element_at(F.try_variant_get(body, "$", "array<variant>"), F.lit(at)) if at < 0 else F.try_variant_get(body, f"$[{at}]", "variant")
            body = F.coalesce(placed, named)
        else:
            body = named
    return body


def _equals(field: Field, value: Any) -> Column:
    """Null or false where it doesn't hold, so that it stays a plain comparison that scans can use."""
    if value is None:
        return field.missing()
    if isinstance(value, (bool, int, float)):
        return field.number() == F.lit(float(value) if isinstance(value, float) or field.variant else int(value))
    if isinstance(value, str):
        return field.text() == F.lit(value)
    if isinstance(value, (list, tuple)):
        items = field.items()
        if items is None:
            return F.lit(False)
        whole = F.size(items[0]) == len(value)
        return reduce(and_, [_item_equals(F.get(items[0], F.lit(i)), items[1], v) for i, v in enumerate(value)], whole)
    raise TypeError(f"can't compare with {type(value).__name__}")


def _not(holds: Column) -> Column:
    return ~F.coalesce(holds, F.lit(False))


def _item_equals(item: Column, kind: T.DataType, value: Any) -> Column:
    if isinstance(kind, T.VariantType):
        said = F.schema_of_variant(item)
        if value is None:
            return item.isNull() | (said == "VOID")
        if isinstance(value, str):
            return (said == "STRING") & (F.try_variant_get(item, "$", "string") == value)
        return (said != "STRING") & (F.try_variant_get(item, "$", "double") == float(value))
    if value is None:
        return item.isNull()
    if isinstance(value, str) != isinstance(kind, T.StringType):
        return F.lit(False)
    return item == F.lit(value)


def _compares(field: Field, op: str, value: Any) -> Column:
    side = field.text() if isinstance(value, str) else field.number()
    return {"$gt": side > value, "$gte": side >= value, "$lt": side < value, "$lte": side <= value}[op]


def _contains(field: Field, value: Any) -> Column:
    found = F.contains(field.text(), F.lit(value)) if isinstance(value, str) else F.lit(False)
    items = field.items()
    if items is None:
        return found
    listed = F.exists(items[0], lambda x: _item_equals(x, items[1], value))
    return F.coalesce(listed, F.lit(False)) | F.coalesce(found, F.lit(False)) if field.variant else listed


def _any_of(field: Field, values: list) -> Column:
    """$in over plain values of one kind is one IN, which scans can use."""
    alike = len({isinstance(v, str) for v in values}) == 1 and all(isinstance(v, (str, int, float)) for v in values)
    if alike and not field.variant:
        return (field.text() if isinstance(values[0], str) else field.number()).isin(*values)
    return reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), [_equals(field, v) for v in values], F.lit(False))


def condition(field: Field, said: Any) -> Column:
    if not isinstance(said, dict):
        return _equals(field, said)
    out = []
    for op, value in said.items():
        if op == "$eq":
            out.append(_equals(field, value))
        elif op == "$ne":
            out.append(_not(_equals(field, value)))
        elif op in ("$gt", "$gte", "$lt", "$lte"):
            out.append(_compares(field, op, value))
        elif op == "$in":
            out.append(_any_of(field, list(value)))
        elif op == "$nin":
            out.append(_not(_any_of(field, list(value))))
        elif op == "$contains":
            out.append(_contains(field, value))
        elif op == "$regex":
            out.append(field.text().rlike(value))
        else:
            raise ValueError(f"unknown operator {op}")
    return reduce(and_, out) if out else F.lit(True)


def matches(docs: DataFrame, filters: dict[str, Any], body: str = "body") -> DataFrame:
    kind = docs.schema[body].dataType
    said = [condition(Field(body, kind, path), c) for path, c in filters.items()]
    return docs.where(reduce(and_, said)) if said else docs


def project(docs: DataFrame, paths: dict[str, str], body: str = "body") -> DataFrame:
    """doc_id and a column for each name: path; of variants, JSON text."""
    kind = docs.schema[body].dataType
    columns = []
    for name, path in paths.items():
        field = Field(body, kind, path)
        columns.append((F.to_json(field.raw()) if field.variant else field.value).alias(name))
    return docs.select("doc_id", *columns)


def ordered(docs: DataFrame, by: str | None, reverse: bool = False, body: str = "body") -> list[Column]:
    """Nulls last, or first in reverse; ties by doc_id either way."""
    if by is None:
        return [F.col("doc_id").asc()]
    key = Field(body, docs.schema[body].dataType, by).sort_key()
    return [key.desc_nulls_first() if reverse else key.asc_nulls_last(), F.col("doc_id").asc()]


def find(docs: DataFrame, filters: dict[str, Any] | None = None, where: Column | None = None, sort_by: str | None = None, reverse: bool = False, limit: int | None = 100, offset: int = 0, body: str = "body") -> DataFrame:
    """The whole query: filters, a predicate, order and page, as one plan."""
    rows = matches(docs, filters or {}, body)
    if where is not None:
        rows = rows.where(where)
    rows = rows.orderBy(*ordered(rows, sort_by, reverse, body))
    if offset:
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)


def merge(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """Shallow update of map bodies: the patch's keys replace the document's; documents without a patch stay."""
    new = patches.select("doc_id", F.col("body").alias("_patch"))
    empty = F.create_map().cast(docs.schema["body"].dataType)
    patch = F.coalesce("_patch", empty)
    kept = F.map_filter("body", lambda k, _: ~F.map_contains_key(patch, k))
    return docs.join(new, "doc_id", "left").select("doc_id", F.map_concat(kept, patch).alias("body"))


def index(docs: DataFrame, path: str, body: str = "body") -> DataFrame:
    """(value, doc_id) sorted by value: an access path to write beside a collection."""
    field = Field(body, docs.schema[body].dataType, path)
    return docs.select(field.value.alias("value"), "doc_id").where("value IS NOT NULL")


def lookup(docs: DataFrame, indexed: DataFrame, value: Any) -> DataFrame:
    return docs.join(indexed.where(F.col("value") == F.lit(value)).select("doc_id"), "doc_id", "left_semi")
