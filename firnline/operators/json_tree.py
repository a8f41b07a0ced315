"""JSON documents as tables of their nodes: walked level by level, held against a schema, and written again in one form.

A document becomes a row for each value at any depth, so large documents are dealt out like any other rows; each level
is a table, and as many rounds are needed as documents are deep. Nothing here runs Python on values; only keys beyond
ASCII go through it.

Joins of nodes with nodes say ``merge``: Spark guesses the size of a table from its compressed files, and node tables
compress a hundredfold, so it would send whole ones to every task through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.functions.order import dictionary
from firnline.functions.text import nfkc
from firnline.operators.digest import FORBIDDEN, LEAKS
from firnline.sources.rounds import Rounds

NODE = ["id", "depth", "path", "parent", "pattern", "parent_pattern", "key", "place", "kind", "text"]
MAP, LIST = "map<string,variant>", "array<variant>"


def _kind(v: Column) -> Column:
    scalar = F.schema_of_variant(v)
    return F.when(F.try_variant_get(v, "$", MAP).isNotNull(), "object").when(F.try_variant_get(v, "$", LIST).isNotNull(), "array").when(scalar == "VOID", "null").when(scalar == "STRING", "string").when(scalar == "BOOLEAN", "boolean").otherwise("number")


def _plain(key: Column) -> Column:
    """A key as a part of a pattern: points in it do not divide."""
    return F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit("."), F.lit("\\."))


def walk(docs: DataFrame, tables: Rounds) -> list[DataFrame]:
    """``NODE`` of every value of the documents (id, json), a table for each depth; texts that are no JSON have no rows.

    A path is $ with .key and [place]; a pattern has [] for places. ``text`` is a scalar's value, numbers and booleans as
    JSON writes them. Of equal keys in one object the last counts. Null documents have no rows.
    """
    none = F.lit(None).cast("string")
    level = docs.select("id", F.try_parse_json("json").alias("v")).where("v is not null").select(
        "id", F.lit(0).alias("depth"), F.lit("$").alias("path"), none.alias("parent"), F.lit("$").alias("pattern"), none.alias("parent_pattern"), none.alias("key"), F.lit(0).alias("place"), "v")
    levels = []
    while True:
        at = level.withColumn("kind", _kind(F.col("v")))
        scalar = ~F.col("kind").isin("object", "array")
        now = tables.put(at.withColumn("text", F.when(scalar & (F.col("kind") != "null"), F.try_variant_get("v", "$", "string"))).select(*NODE, F.when(~scalar, F.col("v")).alias("v")), f"level{len(levels)}")
        levels.append(now.drop("v"))
        inner = now.where("v is not null")
        if inner.isEmpty():
            return levels
        up = [F.col("path").alias("parent"), F.col("pattern").alias("parent_pattern")]
        fields = inner.where("kind = 'object'").select("id", (F.col("depth") + 1).alias("depth"), *up, F.explode(F.try_variant_get("v", "$", MAP)).alias("key", "v"))
        fields = fields.select("id", "depth", F.concat_ws(".", "parent", "key").alias("path"), "parent", F.concat_ws(".", "parent_pattern", _plain(F.col("key"))).alias("pattern"), "parent_pattern", "key", F.lit(0).alias("place"), "v")
        items = inner.where("kind = 'array'").select("id", (F.col("depth") + 1).alias("depth"), *up, F.posexplode(F.try_variant_get("v", "$", LIST)).alias("place", "v"))
        items = items.select("id", "depth", F.concat("parent", F.lit("["), F.col("place").cast("string"), F.lit("]")).alias("path"), "parent", F.concat("parent_pattern", F.lit("[]")).alias("pattern"), "parent_pattern", none.alias("key"), "place", "v")
        level = fields.unionByName(items)


def together(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def quoted(x: Column) -> Column:
    """A string as JSON writes it."""
    array = F.to_json(F.array(x))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def number_text(x: Column) -> Column:
    """A number as ECMAScript writes it: no point in whole ones, plain digits from 1e-6 to 1e21; null if it is not finite.

    The digits are the JVM's, which before its version 19 writes a digit too many for a few numbers, such as the least double.
    """
    size, text = F.abs(x), x.cast("string")
    whole = x.try_cast("decimal(38,0)").cast("string")
    shown = F.regexp_replace(F.when(size < 1, text.try_cast("decimal(38,30)")).otherwise(text.try_cast("decimal(38,18)")).cast("string"), r"\.?0+$", "")
    mantissa, power = F.regexp_replace(F.regexp_extract(text, "^([^E]*)", 1), r"\.0$", ""), F.regexp_extract(text, "E(.*)$", 1)
    far = F.concat(mantissa, F.lit("e"), F.when(F.startswith(power, F.lit("-")), power).otherwise(F.concat(F.lit("+"), power)))
    return F.when(F.isnan(x) | (size == float("inf")), F.lit(None)).when(x == 0, "0").when((size >= 1e21) | (size < 1e-6), far).when(x == F.rint(x), whole).otherwise(shown)


def written(levels: list[DataFrame], tables: Rounds, by: str = "units", down_to: int = 0) -> DataFrame:
    """``NODE`` of depth ``down_to`` with json: the value in one form, whatever the order and spacing it came in.

    Keys stand in the order of their code points (``units``) or as in a dictionary (``letters``), then by code point;
    numbers as ECMAScript writes them; a value with a number that is not finite has none. Objects and arrays are put
    together from their parts, the deepest first; an object's parts meet in one group.
    """
    order = F.col("key") if by == "units" else dictionary(F.col("key"), numeric=False)
    below = None
    for n in range(len(levels) - 1, down_to - 1, -1):
        now = levels[n]
        number = number_text(F.col("text").try_cast("double"))
        own = F.when(F.col("kind") == "string", quoted(F.col("text"))).when(F.col("kind") == "null", "null").when(F.col("kind") == "boolean", F.col("text")).when(F.col("kind") == "number", number)
        if below is None:
            parts = now.select(F.col("id").alias("_i"), F.col("path").alias("_p"), F.lit(None).cast("string").alias("parts"), F.lit(False).alias("bad")).limit(0)
        else:
            piece = F.when(F.col("key").isNotNull(), F.concat(quoted(F.col("key")), F.lit(":"), F.col("json"))).otherwise(F.col("json"))
            listed = F.array_sort(F.collect_list(F.struct(F.col("place").alias("n"), order.alias("o"), F.col("key").alias("k"), piece.alias("t"))))
            parts = below.groupBy(F.col("id").alias("_i"), F.col("parent").alias("_p")).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ",").alias("parts"), F.bool_or(F.col("json").isNull()).alias("bad"))
        j = now.join(parts.hint("merge"), (F.col("id") == F.col("_i")) & (F.col("path") == F.col("_p")), "left")
        inside = F.coalesce("parts", F.lit(""))
        whole = F.when(F.coalesce("bad", F.lit(False)), F.lit(None)).when(F.col("kind") == "object", F.concat(F.lit("{"), inside, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), inside, F.lit("]"))).otherwise(own)
        below = tables.put(j.select(*NODE, whole.alias("json")), f"written{n}")
    return below


def canonical_hashes(docs: DataFrame, by: str = "units") -> DataFrame:
    """id and hash (sha256: and hexadecimal digits) of documents (id, json); null where a text is no JSON or not finite."""
    tables = Rounds(docs.sparkSession, "canonical")
    found = written(walk(docs, tables), tables, by)
    return docs.select("id").join(found.select(F.col("id").alias("_d"), F.concat(F.lit("sha256:"), F.sha2("json", 256)).alias("hash")).hint("merge"), F.col("id") == F.col("_d"), "left").select("id", "hash")


# A schema is nested: {"object": {key: schema}}, {"array": schema}, {"string": {"values": [...], "check": name}},
# "string", "number", "boolean", and {"null": schema} where null is allowed; a key that ends in ? may be missing.
SCHEMA = "pattern string, parent string, key string, kind string, nullable boolean, optional boolean, values array<string>, rule string"


def schema_rows(schema, pattern: str = "$", parent: str | None = None, key: str | None = None, optional: bool = False) -> Iterator[tuple]:
    nullable = isinstance(schema, dict) and "null" in schema
    schema = schema["null"] if nullable else schema
    kind = schema if isinstance(schema, str) else next(iter(schema))
    more = schema["string"] if kind == "string" and isinstance(schema, dict) else {}
    yield pattern, parent, key, kind, nullable, optional, more.get("values"), more.get("check")
    if kind == "object":
        for name, inner in schema["object"].items():
            bare = name.removesuffix("?")
            plain = bare.replace("\\", "\\\\").replace(".", "\\.")
            yield from schema_rows(inner, f"{pattern}.{plain}", pattern, bare, name != bare)
    if kind == "array":
        yield from schema_rows(schema["array"], f"{pattern}[]", pattern)


def schema_table(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame(list(schema_rows(schema)), SCHEMA)


def _holds(rule: Column, text: Column) -> Column:
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    instant = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$") & text.try_cast("timestamp").isNotNull()
    path = F.startswith(text, F.lit("/")) & ~F.startswith(text, F.lit("//")) & ~F.contains(text, F.lit("?")) & ~F.contains(text, F.lit("#"))
    rules = {"date": F.coalesce(F.date_format(day, "yyyy-MM-dd") == text, F.lit(False)), "hash": text.rlike("^sha256:[a-f0-9]{64}$"), "instant": F.coalesce(instant, F.lit(False)), "path": path}
    out = F.lit(True)
    for name, good in rules.items():
        out = F.when(rule == name, good).otherwise(out)
    return out


def schema_faults(nodes: DataFrame, schema: DataFrame) -> DataFrame:
    """id and fault (schema:path:what) of values of the wrong kind, unknown keys and missing keys, each where it is; nothing below an unknown key.

    The schema is a table with a row for each of its places, so it is as small as it was written.
    """
    s = F.broadcast(schema.select(F.col("pattern").alias("_s"), F.col("kind").alias("_kind"), "nullable", "values", "rule"))
    typed = nodes.join(s, F.col("pattern") == F.col("_s"))
    fits = (F.col("kind") == F.col("_kind")) & (F.col("values").isNull() | F.array_contains("values", F.coalesce("text", F.lit("")))) & (F.col("rule").isNull() | _holds(F.col("rule"), F.coalesce("text", F.lit(""))))
    number = F.when(F.col("kind") == "number", number_text(F.col("text").try_cast("double")).isNotNull()).otherwise(True)
    wrong = typed.where(~((F.col("nullable") & (F.col("kind") == "null")) | (fits & number))).select("id", F.concat(F.lit("schema:"), "path", F.lit(":invalid_"), "_kind").alias("fault"))
    of_object = F.broadcast(schema.where("kind = 'object'").select(F.col("pattern").alias("_o")))
    unknown = nodes.where("key is not null").join(of_object, F.col("parent_pattern") == F.col("_o")).join(F.broadcast(schema.select(F.col("pattern").alias("_s"))), F.col("pattern") == F.col("_s"), "left_anti")
    due = F.broadcast(schema.where("not optional and key is not null").select(F.col("parent").alias("_due"), F.col("key").alias("_key")))
    wanted = nodes.where("kind = 'object'").join(due, F.col("pattern") == F.col("_due")).select("id", F.col("path").alias("_at"), "_key")
    have = nodes.where("key is not null").select(F.col("id").alias("_id"), F.col("parent").alias("_parent"), F.col("key").alias("_have"))
    missing = wanted.join(have.hint("merge"), (F.col("id") == F.col("_id")) & (F.col("_at") == F.col("_parent")) & (F.col("_key") == F.col("_have")), "left_anti")
    return wrong.unionByName(unknown.select("id", F.concat(F.lit("schema:"), "path", F.lit(":unknown_key")).alias("fault"))).unionByName(missing.select("id", F.concat(F.lit("schema:"), "_at", F.lit("."), "_key", F.lit(":missing_key")).alias("fault")))


def privacy_faults(nodes: DataFrame) -> DataFrame:
    """id and fault (privacy:path:what) of forbidden keys and of strings that look like addresses or secrets."""
    key, plain = F.col("key"), F.col("key").rlike(r"^[\x00-\x7F]*$")
    forbidden = lambda x: F.coalesce(F.regexp_replace(F.lower(x), "[^a-z0-9]", "").isin(sorted(FORBIDDEN)), F.lit(False))
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    found = F.array_compact(F.array(F.when(plain & forbidden(key), "forbidden_key"), *[F.when((F.col("kind") == "string") & text.rlike(p), name) for name, p in LEAKS.items()]))
    here = nodes.select("id", "path", F.explode(found).alias("what"))
    # ASCII is its own composition, so few keys need Python
    folded = nodes.where(~plain).select("id", "path", nfkc(key).alias("key")).where(forbidden(key)).select("id", "path", F.lit("forbidden_key").alias("what"))
    return here.unionByName(folded).select("id", F.concat_ws(":", F.lit("privacy"), "path", "what").alias("fault"))


def faults(docs: DataFrame, schema) -> DataFrame:
    """id and faults (sorted, each once) of every document (id, json); one that is no JSON has the fault schema:$:invalid_json."""
    tables = Rounds(docs.sparkSession, "faults")
    nodes = together(walk(docs, tables))
    found = schema_faults(nodes, schema_table(docs.sparkSession, schema)).unionByName(privacy_faults(nodes)).groupBy(F.col("id").alias("_i")).agg(F.array_sort(F.collect_set("fault")).alias("faults"))
    good = docs.select("id", F.try_parse_json("json").isNotNull().alias("good"))  # before the join, so that no document is moved
    empty = F.array().cast("array<string>")
    return good.join(found.hint("merge"), F.col("id") == F.col("_i"), "left").select("id", F.when(~F.col("good"), F.array(F.lit("schema:$:invalid_json"))).otherwise(F.coalesce("faults", empty)).alias("faults"))
