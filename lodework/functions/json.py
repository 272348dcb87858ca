"""JSON columns: path predicates, schema audits and nested documents.

Texts are parsed once into VARIANT; every test then reads typed values from it.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.operators.ordered import HOT_ROWS, paged

COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    "in": lambda a, b: a.isin(b),
}


def variant_type(value) -> str:
    """Type under which a Python value is read from a VARIANT."""
    if isinstance(value, (list, tuple, set)):
        return variant_type(next(iter(value)))
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint"
    if isinstance(value, float):
        return "double"
    return "string"


def path_test(parsed: Column, path: str, op: str, value=None) -> Column:
    """Predicate on a path of a VARIANT; a missing path or a value of another kind is false."""
    if op == "exists":
        return F.try_variant_get(parsed, path, "variant").isNotNull()
    kind = variant_type(value)
    found = F.try_variant_get(parsed, path, kind)
    shape = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    same_kind = {"string": shape == "STRING", "boolean": shape == "BOOLEAN"}.get(
        kind, shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))
    if kind == "bigint" and op != "in":
        # whole numbers compare as such, fractions as doubles
        whole = shape.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
        exact = COMPARE[op](F.try_variant_get(parsed, path, "decimal(38,0)"), F.lit(value).cast("decimal(38,0)"))
        return F.coalesce(same_kind & F.when(whole, exact).otherwise(COMPARE[op](F.try_variant_get(parsed, path, "double"), F.lit(float(value)))), F.lit(False))
    return F.coalesce(same_kind & COMPARE[op](found, list(value) if op == "in" else F.lit(value)), F.lit(False))


def json_where(df: DataFrame, column: str, path: str, op: str, value=None) -> DataFrame:
    """Rows whose JSON text satisfies a predicate on a path such as ``$.a.b``; bad JSON never does."""
    return (df.withColumn("_v", F.try_parse_json(column)).where(path_test(F.col("_v"), path, op, value)).drop("_v"))


# Names of the JSON types and the VARIANT shapes they cover.
TYPE_SHAPES = {
    "object": "^OBJECT<", "array": "^ARRAY<", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
}


def _member(name: str) -> str:
    """Path of a member, whatever characters its name has."""
    if "'" in name and '"' in name:
        raise ValueError(f"cannot address member {name}")
    return f'$["{name}"]' if "'" in name else f"$['{name}']"


def _as_json(value) -> Column:
    """A constant as the text a VARIANT of it has."""
    return F.to_json(F.parse_json(F.lit(json.dumps(value))))


def _violations(schema: dict, value: Column, path: str) -> list[tuple[str, Column]]:
    """(rule, violated) for one schema node; a rule on another type than the value's is met."""
    shape = F.schema_of_variant(value)
    present = value.isNotNull()
    number = F.when(shape.rlike(TYPE_SHAPES["number"]), F.try_variant_get(value, "$", "double"))
    text = F.when(shape == "STRING", F.try_variant_get(value, "$", "string"))
    items = F.when(shape.rlike(TYPE_SHAPES["array"]), F.try_variant_get(value, "$", "array<variant>"))
    is_object = shape.rlike(TYPE_SHAPES["object"])
    fields = F.when(is_object, F.try_variant_get(value, "$", "map<string,variant>"))
    found: list[tuple[str, Column]] = []

    def rule(keyword: str, violated: Column) -> None:
        found.append((f"{path} {keyword}", present & F.coalesce(violated, F.lit(False))))

    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        whole = F.coalesce(number == F.floor(number), F.lit(False)) if "integer" in names else F.lit(False)
        rule("type", ~(reduce(lambda a, b: a | b, [shape.rlike(TYPE_SHAPES[n]) for n in names]) | whole))
    if "enum" in schema:
        rule("enum", ~F.to_json(value).isin([_as_json(e) for e in schema["enum"]]))
    if "const" in schema:
        rule("const", F.to_json(value) != _as_json(schema["const"]))
    bounds = {"minimum": lambda b: number < b, "maximum": lambda b: number > b,
              "exclusiveMinimum": lambda b: number <= b, "exclusiveMaximum": lambda b: number >= b,
              "multipleOf": lambda b: number % b != 0,
              "minLength": lambda b: F.length(text) < b, "maxLength": lambda b: F.length(text) > b,
              "pattern": lambda b: ~text.rlike(b),
              "minItems": lambda b: F.size(items) < b, "maxItems": lambda b: F.size(items) > b}
    for keyword, test in bounds.items():
        if keyword in schema:
            rule(keyword, F.when({"minLength": text, "maxLength": text, "pattern": text, "minItems": items,
                                  "maxItems": items}.get(keyword, number).isNotNull(), test(schema[keyword])))
    for name in schema.get("required", []):
        rule(f"required {name}", is_object & F.try_variant_get(value, _member(name), "variant").isNull())
    if schema.get("additionalProperties") is False:
        known = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
        rule("additionalProperties", F.size(F.array_except(F.map_keys(fields), known)) > 0)
    for name, child in schema.get("properties", {}).items():
        found += _violations(child, F.try_variant_get(value, _member(name), "variant"), f"{path}.{name}")
    if isinstance(schema.get("items"), dict):
        rule("items", F.exists(items, lambda x: _any(_violations(schema["items"], x, ""))))
    return found


def _any(rules: list[tuple[str, Column]]) -> Column:
    return reduce(lambda a, b: a | b, [violated for _, violated in rules], F.lit(False))


def validate_json(df: DataFrame, column: str, schema: dict, name: str = "violations") -> DataFrame:
    """Adds the list of rules each JSON text breaks (empty when it is valid; ``$ json`` if it is no JSON)."""
    parsed = F.try_parse_json(column)
    rules = _violations(schema, F.col("_v"), "$")
    broken = F.filter(F.array(F.when(F.col("_v").isNull() & F.col(column).isNotNull(), F.lit("$ json")),
                              *[F.when(violated, F.lit(rule)) for rule, violated in rules]), lambda x: x.isNotNull())
    return df.withColumn("_v", parsed).withColumn(name, broken).drop("_v")


def json_matches_schema(df: DataFrame, column: str, schema: dict, name: str = "valid") -> DataFrame:
    return validate_json(df, column, schema, "_broken").withColumn(name, F.size("_broken") == 0).drop("_broken")


def json_schema_audit(df: DataFrame, column: str, schema: dict) -> DataFrame:
    """(rule, violations): how often each rule is broken, in one pass."""
    # the outer form keeps the optimizer from testing the list, and so parsing the text again, below the explode
    return (validate_json(df, column, schema).select(F.explode_outer("violations").alias("rule"))
            .where(F.col("rule").isNotNull()).groupBy("rule").agg(F.count(F.lit(1)).alias("violations")))


def nest(parent: DataFrame, child: DataFrame, parent_key: str, fk: str, order: list[Column], name: str = "children",
         page_rows: int = 100_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(parent_key, page, document): each parent as JSON with its children as an ordered list.

    Children beyond ``page_rows`` continue in further documents of the same parent, so a parent with
    very many children never becomes one row.
    """
    fields = [c for c in child.columns if c != fk]
    lists = paged(child, [fk], order, page_rows, hot_rows).groupBy(fk, "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("_rn"), F.struct(*fields).alias("c")))),
                    lambda x: x["c"]).alias(name))
    joined = parent.join(lists.withColumnRenamed(fk, "_fk"), parent[parent_key] == F.col("_fk"), "left")
    empty = F.array().cast(lists.schema[name].dataType)
    body = F.struct(*[parent[c] for c in parent.columns], F.coalesce(name, empty).alias(name))
    return joined.select(parent[parent_key], F.coalesce("page", F.lit(0)).alias("page"), F.to_json(body).alias("document"))
