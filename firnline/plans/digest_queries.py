"""Digests of reports and faults of stored digests, a document for each supplier, with one figure and one fault of its own."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.operators import json_tree, report_digest
from firnline.plans import bindings as b

VERSION = report_digest.VERSION
#: Where a document has a figure of its own.
MARK = 987654321
#: Suppliers of one part of the dealt table: each has a document of many nodes.
DOCUMENTS = 500
HASH = "sha256:" + "0" * 64
DAYS = {"yesterday": ("2024-01-14", "2024-01-14"), "last7Days": ("2024-01-08", "2024-01-14"), "previous7Days": ("2024-01-01", "2024-01-07"), "last30Days": ("2023-12-16", "2024-01-14"), "previous30Days": ("2023-11-16", "2023-12-15")}
TEXTS = {"date": "2024-01-14", "hash": HASH, "instant": "2024-01-15T06:30:00.000Z", "path": "/boards"}


def filled(schema, at: str = "$"):
    """A document with something in every place of a schema."""
    if isinstance(schema, dict) and "null" in schema:
        return filled(schema["null"], at)
    kind = schema if isinstance(schema, str) else next(iter(schema))
    if kind == "object":
        return {k.removesuffix("?"): filled(v, f"{at}.{k}") for k, v in schema["object"].items()}
    if kind == "array":
        return [filled(schema["array"], f"{at}[]")] * 2
    if kind == "string":
        more = schema["string"] if isinstance(schema, dict) else {}
        return (more.get("values") or [TEXTS.get(more.get("check"), "words «of» \"it\"")])[0]
    return len(at) % 3 == 0 if kind == "boolean" else len(at) * 5 / 4


def digest_sample() -> dict:
    out = filled(report_digest.digest_schema())
    out["periods"] = {w: {"startDate": a, "endDate": z} for w, (a, z) in DAYS.items()}
    out["traffic"]["last7Days"]["users"] = MARK
    return out


def report_sample() -> dict:
    """A report of which ``digest_sample`` is the digest, with what a digest leaves out."""
    d = digest_sample()
    out = {k: v for k, v in d.items() if k not in ("kind", "logicalId", "status", "sourceReport", "sampling", "periods", "delivery")}
    traffic = {w: d["traffic"][w] | {"sampling": d["sampling"]["traffic"][w], "bounces": 4} for w in DAYS} | {"sourcesSampling": d["sampling"]["traffic"]["sources30Days"], "bySource": [{"source": "x"}]}
    seen = d["sampling"]["acquisition"]
    acquisition = d["acquisition"] | {w: d["acquisition"][w] | {"sampling": seen[w]} for w in ("last7Days", "last30Days")} | {"sourcesSampling": seen["sources30Days"], "landingPagesSampling": seen["landingPages30Days"], "sourceStatus": d["sourceStatus"]["acquisition"] | {"message": "m"}}
    status = {k: v for k, v in d["sourceStatus"].items() if k != "acquisition"} | {"internal": "x"}
    return out | {"version": "report-v3", "windows": d["periods"], "traffic": traffic, "acquisition": acquisition, "sourceStatus": status, "sessions": [{"sessionId": "s"}], "email": "a@b.cc"}


def _text(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


#: What is put into a digest, by the number of its supplier: old text, new text.
FAULTS = [
    ("", ""),
    ('"asOfDate":"2024-01-14",', ""),
    ('"funnel":{', '"extra":{"deep":[1]},"funnel":{'),
    (f'"users":{MARK}', '"users":"many"'),
    ('"startDate":"2024-01-08"', '"startDate":"2024-02-30"'),
    ('"strictOutreachReady":', '"strictOutreachReady":null,"notes":'),
    ('"path":"/boards"', '"path":"//boards?a=1"'),
    ('"label":"words', '"label":"https://words'),
    ('"timezone":"Europe/Moscow"', '"timezone":"UTC","Session_ID":"s"'),
    ('"code":"words «of» \\"it\\""', '"code":" Bearer abc "'),
    ('"failingMetrics":[', '"failingMetrics":["a@b.cc",'),
    ('"manualChecks":[', '"manualChecks":{"x":['),
    ('"sampling":{', '"sampling":[],"old":{'),
    ('"merchants30Days":[', '"merchants30Days":[null,7,'),
]


def _sized(text: str, k: Column) -> Column:
    return F.replace(F.lit(text), F.lit(str(MARK)), k.cast("string"))


def digest_faults(s: SparkSession, d: str) -> DataFrame:
    """Every fault of every stored digest, at any depth."""
    k = F.col("s_suppkey")
    doc = F.lit(_text(digest_sample()))
    for i, (old, new) in enumerate(FAULTS):
        if old:
            doc = F.when(k % len(FAULTS) == i, F.replace(F.lit(_text(digest_sample())), F.lit(old), F.lit(new))).otherwise(doc)
    docs = b.dealt(s, d, "supplier", "s_suppkey", rows=DOCUMENTS).select(k.cast("string").alias("id"), F.replace(doc, F.lit(str(MARK)), k.cast("string")).alias("json"))
    return json_tree.faults(docs, report_digest.digest_schema()).select("id", F.array_join("faults", ",").alias("faults"))


def report_digests(s: SparkSession, d: str) -> DataFrame:
    """Digests with their hashes; every fifth report has a source that is out, every seventh a period that is no week, every eleventh a fault."""
    k = F.col("s_suppkey")
    doc = _sized(_text(report_sample()), k)
    doc = F.when(k % 5 == 0, F.replace(doc, F.lit('"metrika":{"status":"ok"'), F.lit('"metrika":{"status":"unavailable"'))).otherwise(doc)
    doc = F.when(k % 7 == 0, F.replace(doc, F.lit('"endDate":"2024-01-07"'), F.lit('"endDate":"2024-01-06"'))).otherwise(doc)
    doc = F.when(k % 11 == 0, F.replace(doc, F.lit('"severity":"info"'), F.lit('"severity":"loud"'))).when(k % 13 == 0, F.replace(doc, F.lit('"label":"words'), F.lit('"label":"https://words'))).otherwise(doc)
    reports = b.dealt(s, d, "supplier", "s_suppkey", rows=DOCUMENTS).select(k.cast("string").alias("id"), F.when(k % 2 == 0, "weekly").otherwise("daily").alias("kind"), doc.alias("json"))
    return report_digest.build_digests(reports).select("id", "logical_id", "status", "evidence_hash", "content_hash", F.length("digest").cast("long").alias("length"), "problem")


QUERIES = [digest_faults, report_digests]
