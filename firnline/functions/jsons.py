"""Event payloads and click properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)"


def _kind(v: Column) -> Column:
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def payload_object(text: Column) -> Column:
    """The payload as a variant object: an object as it is, a JSON string that holds an object unpacked, else null."""
    v = F.try_parse_json(text)
    inner = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    return F.when(_kind(v) == "OBJECT", v).when((_kind(v) == "STRING") & (_kind(inner) == "OBJECT"), inner)


def is_legacy(text: Column) -> Column:
    """A payload stored as a JSON string."""
    return F.coalesce(_kind(F.try_parse_json(text)) == "STRING", F.lit(False))


def is_invalid(text: Column) -> Column:
    """Neither an object nor a string that holds JSON."""
    v = F.try_parse_json(text)
    return F.when(_kind(v) == "OBJECT", False).when(_kind(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string")).isNull()).otherwise(True)


def field(v: Column, name: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get(v, f"$.{name}", "string")), F.lit(""))


def merchant(url: Column) -> Column:
    """Host of a URL; a lower-case leading ``www.`` goes before lower-casing."""
    host = F.regexp_extract(url, AUTHORITY, 1)
    return F.nullif(F.lower(F.regexp_replace(host, r"^www\.", "")), F.lit(""))
