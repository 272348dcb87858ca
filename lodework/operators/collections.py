"""Document collections: DataFrame(_id string, doc VARIANT)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodework.functions.json import path_test
from lodework.operators.tabular import all_of

OPERATORS = {"$eq": "=", "$ne": "!=", "$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<=", "$in": "in"}


def collection(df: DataFrame, id_col: str, json_text: str) -> DataFrame:
    """Collection from a table with an id and a JSON text."""
    texts = df.select(F.col(id_col).cast("string").alias("_id"), F.col(json_text).alias("_text"))
    return texts.select("_id", once(F.parse_json("_text")).alias("doc"))


def once(value: Column) -> Column:
    """A costly value that later filters read as a column.

    Filters move below plain projections and would compute it again for each mention; they do not move
    below one that depends on the task.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def documents(spark: SparkSession, docs: list[dict]) -> DataFrame:
    """Collection from a short list of Python documents."""
    rows = [(str(d["_id"]), json.dumps({k: v for k, v in d.items() if k != "_id"})) for d in docs]
    return collection(spark.createDataFrame(rows, "id string, j string"), "id", "j")


def insert(coll: DataFrame, docs: DataFrame) -> DataFrame:
    """Collection with more documents; an ``_id`` that occurs twice is refused."""
    new = docs.select("_id")
    twice = new.groupBy("_id").count().where("count > 1").select("_id").head(1) or coll.select("_id").join(new, "_id", "left_semi").head(1)
    if twice:
        raise ValueError(f"duplicate _id {twice[0][0]}")
    return coll.unionByName(docs)


def _path(field: str) -> str:
    return "$." + field


def condition(query: dict) -> Column:
    """Predicate of a filter document: equality, comparison operators, $exists, $and, $or, $nor."""
    parts = []
    for field, wanted in query.items():
        if field in ("$and", "$or", "$nor"):
            branches = [condition(q) for q in wanted]
            joined = branches[0]
            for b in branches[1:]:
                joined = joined & b if field == "$and" else joined | b
            parts.append(~joined if field == "$nor" else joined)
        elif isinstance(wanted, dict) and any(k.startswith("$") for k in wanted):
            for op, value in wanted.items():
                if field == "_id":
                    parts.append(_id_test(OPERATORS[op], value))
                elif op == "$exists":
                    there = path_test(F.col("doc"), _path(field), "exists")
                    parts.append(there if value else ~there)
                elif op == "$ne":  # also true where the field is missing
                    parts.append(~path_test(F.col("doc"), _path(field), "=", value))
                elif op == "$nin":
                    parts.append(~path_test(F.col("doc"), _path(field), "in", value))
                else:
                    parts.append(path_test(F.col("doc"), _path(field), OPERATORS[op], value))
        elif field == "_id":
            parts.append(F.col("_id") == str(wanted))
        elif wanted is None:
            parts.append(F.coalesce(F.is_variant_null(F.try_variant_get("doc", _path(field), "variant")), F.lit(True)))
        elif isinstance(wanted, (dict, list)):
            text = F.to_json(F.parse_json(F.lit(json.dumps(wanted))))
            parts.append(F.coalesce(F.to_json(F.try_variant_get("doc", _path(field), "variant")) == text, F.lit(False)))
        else:
            parts.append(path_test(F.col("doc"), _path(field), "=", wanted))
    return all_of(parts)


def _id_test(op: str, value) -> Column:
    from lodework.functions.json import COMPARE

    return COMPARE[op](F.col("_id"), [str(v) for v in value] if op == "in" else F.lit(str(value)))


def find(coll: DataFrame, query: dict | None = None) -> DataFrame:
    return coll.where(condition(query or {}))


def same_document(a: Column, b: Column) -> Column:
    """Equality of documents whatever the order of their keys."""
    return F.to_json(a).eqNullSafe(F.to_json(b))


def _with_field(doc: Column, path: list[str], value) -> Column:
    """Object with one field set; missing objects on the way are created."""
    fields = F.coalesce(F.try_variant_get(doc, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    name = path[0]
    inner = (F.parse_json(F.lit(json.dumps(value))) if len(path) == 1
             else _with_field(F.try_element_at(fields, F.lit(name)), path[1:], value))
    kept = F.map_filter(fields, lambda k, _: k != name)
    return F.to_variant_object(F.map_concat(kept, F.create_map(F.lit(name), inner)))


def _without_field(doc: Column, name: str) -> Column:
    return F.to_variant_object(F.map_filter(F.try_variant_get(doc, "$", "map<string,variant>"), lambda k, _: k != name))


def _target(coll: DataFrame, query: dict, one: bool) -> Column:
    """Rows a change applies to; the ``one`` form takes the matching row of lowest ``_id``."""
    hit = condition(query)
    if not one:
        return hit
    lowest = coll.where(hit).agg(F.min("_id")).scalar()
    return F.coalesce(F.col("_id") == lowest, F.lit(False))


def update(coll: DataFrame, query: dict, change: dict, one: bool = False) -> DataFrame:
    """Collection after ``$set`` (dotted names reach inner objects) and ``$unset`` on matching documents."""
    doc = F.col("doc")
    for field, value in change.get("$set", {}).items():
        doc = _with_field(doc, field.split("."), value)
    for field in change.get("$unset", {}):
        doc = _without_field(doc, field)
    return coll.withColumn("doc", once(F.when(_target(coll, query, one), doc).otherwise(F.col("doc"))))


def delete(coll: DataFrame, query: dict, one: bool = False) -> DataFrame:
    return coll.where(~_target(coll, query, one))


def count_documents(coll: DataFrame, query: dict | None = None) -> int:
    return find(coll, query).count()


def _value(expr, kind: str = "double") -> Column:
    """``"$field"`` reads a field; anything else is a constant."""
    if isinstance(expr, str) and expr.startswith("$"):
        return F.col("_id") if expr == "$_id" else F.try_variant_get("doc", _path(expr[1:]), kind)
    return F.lit(expr)


def _sortable(value: Column) -> list[Column]:
    """Keys that sort VARIANT numbers by value, then texts and the rest, after what is missing or null."""
    number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    kind = F.when(value.isNull() | F.is_variant_null(value), None).when(number, 0).otherwise(1)
    return [kind, F.when(number, F.try_variant_get(value, "$", "double")), F.when(~number, F.try_variant_get(value, "$", "string"))]


def _extreme(pick, expr) -> Column:
    """The least or greatest value of a field as a VARIANT, so with the kind it has; NULL where no document has it."""
    if not (isinstance(expr, str) and expr.startswith("$")):
        return pick(F.lit(1), F.lit(1)) * F.lit(expr)
    value = F.try_variant_get("doc", _path(expr[1:]), "variant")
    kind, number, text = _sortable(value)
    return pick(value, F.when(kind.isNotNull(), F.struct(kind, number, text)))


GROUPERS = {"$sum": lambda e: F.sum(_value(e)), "$avg": lambda e: F.avg(_value(e)),
            "$min": lambda e: _extreme(F.min_by, e), "$max": lambda e: _extreme(F.max_by, e)}


def aggregate(coll: DataFrame, stages: list[dict]) -> DataFrame:
    """Fold $match, $group, $project, $sort and $limit over a collection.

    ``$match`` comes before ``$group`` and reads documents; after ``$group`` or ``$project`` the rows are
    plain columns and ``$match`` compares those.  ``$min``, ``$max`` and ``$project`` keep a value's own kind and give
    VARIANT columns; numbers come before texts.
    """
    df, flat = coll, False
    for stage_ in stages:
        (name, body), = stage_.items()
        if name == "$match":
            df = df.where(all_of([_flat_test(df, f, w) for f, w in body.items()]) if flat else condition(body))
        elif name == "$group":
            key = body["_id"]
            aggs = []
            for out, spec in body.items():
                if out == "_id":
                    continue
                (op, expr), = spec.items()
                if op == "$count" or (op == "$sum" and expr == 1):
                    aggs.append(F.count(F.lit(1)).alias(out))
                else:
                    aggs.append(GROUPERS[op](expr).alias(out))
            keys = [F.lit(None).cast("string").alias("_id")] if key is None else [_value(key, "string").alias("_id")]
            df, flat = df.groupBy(*keys).agg(*aggs), True
        elif name == "$project":
            if flat:
                df = df.select(*[F.col(f) for f, on in body.items() if on])
            else:
                df = df.select("_id", *[_value(on if isinstance(on, str) else "$" + f, "variant").alias(f) for f, on in body.items() if on and f != "_id"])
            flat = True
        elif name == "$sort":
            by = []
            for f, way in body.items():
                plain = f == "_id" or flat and not isinstance(df.schema[f].dataType, T.VariantType)
                for value in [F.col(f)] if plain else _sortable(F.col(f) if flat else F.try_variant_get("doc", _path(f), "variant")):
                    by.append(value.asc_nulls_first() if way > 0 else value.desc_nulls_last())
            df = df.orderBy(*by)
        elif name == "$limit":
            df = df.limit(body)
        else:
            raise ValueError(f"unknown stage {name}")
    return df


def _flat_test(df: DataFrame, field: str, wanted) -> Column:
    from lodework.functions.json import COMPARE

    if isinstance(df.schema[field].dataType, T.VariantType):
        tests = wanted.items() if isinstance(wanted, dict) else [("$eq", wanted)]
        return all_of([path_test(F.col(field), "$", OPERATORS[op], value) for op, value in tests])
    if isinstance(wanted, dict):
        return all_of([COMPARE[OPERATORS[op]](F.col(field), value if op == "$in" else F.lit(value)) for op, value in wanted.items()])
    return F.col(field) == F.lit(wanted)
