"""Nested JSON against rules that are data: a row for each violation, with its place. No join but that with the rules.

A rule is a row (schema, path, type, required, enum, minimum, maximum, closed): ``path`` is ``$`` for the whole, ``$.a`` for a key,
``$.a[]`` for the items of an array; ``type`` one of object, array, string, integer, number, boolean or null for any; ``required``
tells that the object must have the key; ``closed`` objects may have no keys without a rule. Nulls in a rule ask for nothing.

Values of any depth are walked level by level, as deep as the rules go. Integers are numbers too, booleans are neither; limits bind
numbers only; an enumeration lists JSON scalars as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.binding import let
from cairn.session import broadcast_if_small

RULES = "schema string, path string, type string, required boolean, enum array<string>, minimum double, maximum double, closed boolean"
#: Rules are a stated list; up to so many are broadcast.
MAX_RULES = 10_000


def rules_of(spark: SparkSession, schema: str, *rules: tuple) -> DataFrame:
    """Rules as rows: (path, type) and options by name."""
    limit = lambda x: None if x is None else float(x)
    rows = [(schema, path, kind, o.get("required", False), o.get("enum"), limit(o.get("minimum")), limit(o.get("maximum")), o.get("closed", False)) for path, kind, o in ((*r, {})[:3] for r in rules)]
    return spark.createDataFrame(rows, RULES)


def kind_of(value: Column) -> Column:
    """The JSON type of a variant."""
    return let(
        F.schema_of_variant(value),
        lambda said: F.when(said.startswith("OBJECT"), "object").when(said.startswith("ARRAY"), "array").when(said == "STRING", "string").when(said == "BIGINT", "integer")
        .when(said == "BOOLEAN", "boolean").when(said == "VOID", "null").when(said.startswith("DECIMAL") | said.isin("DOUBLE", "FLOAT"), "number").otherwise("other"),
    )


def _by_path(rules: DataFrame) -> DataFrame:
    """A row for each (schema, path) with what it asks for itself and of its keys."""
    parent = F.regexp_replace("path", r"(\.[^.\[\]]+|\[\])$", "")
    key = F.regexp_extract("path", r"\.([^.\[\]]+)$", 1)
    keys = rules.where(F.col("path") != "$").select("schema", parent.alias("path"), key.alias("key"), "required").where("key <> ''")
    keys = keys.groupBy("schema", "path").agg(F.array_sort(F.collect_set("key")).alias("known"), F.array_sort(F.collect_set(F.when(F.col("required"), F.col("key")))).alias("needed"))
    none = F.array().cast("array<string>")
    return rules.drop("required").join(keys, ["schema", "path"], "left").withColumns({"known": F.coalesce("known", none), "needed": F.coalesce("needed", none)})


def violations(rows: DataFrame, rules: DataFrame, *keys: str, value: str = "value", schema: str = "schema") -> DataFrame:
    """(keys, place, rule) of (keys, schema, value), a variant; rule is type, enum, minimum, maximum, required:<key>, additional:<key> or schema.

    A null value is no JSON and breaks ``type``; a schema without rules breaks ``schema``.
    """
    spark = rows.sparkSession
    paths = _by_path(rules)
    levels = 1 + (paths.agg(F.max(F.regexp_count("path", F.lit(r"\.|\[\]")))).first()[0] or 0)
    small = broadcast_if_small(paths, MAX_RULES)
    level = rows.select(*keys, F.col(schema).alias("schema"), F.lit("$").alias("path"), F.lit("$").alias("place"), F.col(value).alias("v"))
    out = None
    for _ in range(levels):
        seen = level.join(small, ["schema", "path"], "left").withColumn("kind", kind_of(F.col("v")))
        found = _found(seen, keys)
        out = found if out is None else out.unionByName(found)
        inner = seen.where("kind in ('object', 'array') and known is not null").select(*keys, "schema", "path", "place", "kind", "v")
        each = spark.sql("SELECT t.*, e.pos, e.key, e.value AS inner_value FROM {t} t, LATERAL variant_explode(t.v) e", t=inner)
        step = F.when(F.col("kind") == "array", F.lit("[]")).otherwise(F.concat(F.lit("."), "key"))
        spot = F.when(F.col("kind") == "array", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        level = each.select(*keys, "schema", F.concat("path", step).alias("path"), F.concat("place", spot).alias("place"), F.col("inner_value").alias("v"))
        level = level.join(F.broadcast(paths.select("schema", "path").distinct()), ["schema", "path"], "left_semi")
    return out


def _found(seen: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    text, number = F.try_variant_get("v", "$", "string"), F.try_variant_get("v", "$", "double")
    is_number = F.col("kind").isin("integer", "number")
    fits = (F.col("type") == F.col("kind")) | ((F.col("type") == "number") & (F.col("kind") == "integer"))
    names = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
    is_object = F.col("kind") == "object"
    none = F.array().cast("array<string>")
    listed = lambda rule, keys_: F.transform(F.coalesce(keys_, none), lambda k: F.concat(F.lit(rule), k))
    one = F.array_compact(
        F.array(
            F.when(F.col("known").isNull() & (F.col("place") == "$"), "schema"),
            F.when(F.col("known").isNotNull() & F.col("type").isNotNull() & ~F.coalesce(fits, F.lit(False)), "type"),
            F.when(F.col("enum").isNotNull() & ~F.coalesce(F.array_contains("enum", text), F.lit(False)), "enum"),
            F.when(is_number & (number < F.col("minimum")), "minimum"),
            F.when(is_number & (number > F.col("maximum")), "maximum"),
        )
    )
    lacking = F.when(is_object, listed("required:", F.array_except("needed", names)))
    more = F.when(is_object & F.col("closed"), listed("additional:", F.array_except(names, "known")))
    every = F.concat(one, F.coalesce(lacking, none), F.coalesce(more, none))
    return seen.select(*keys, "place", F.explode(every).alias("rule"))
