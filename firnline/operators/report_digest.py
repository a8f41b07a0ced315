"""Digests of reports: what may leave the house, under a name, with hashes of its evidence and of its content.

A digest keeps the places of a report that the schema lists, some under another name, and nothing else. Its evidence hash
is the same for the same figures whenever they were made; the time of making is in neither hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.report_text import strict_date, weeks_follow
from firnline.functions.time import iso_week
from firnline.operators import json_tree as tree
from firnline.sources.rounds import Rounds

# The format of a digest.
VERSION, ZONE = "digest-v1", "Europe/Moscow"
WINDOWS = ["yesterday", "last7Days", "previous7Days", "last30Days", "previous30Days"]
GOALS = ["quizStarted", "resultViewed", "productClicked"]
TRENDS = ["users", "visits", "quizCompletedSessions", "resultViewedSessions", "storeClickSessions"]
PARTS = ["traffic", "quizCompletions", "commerceClicks", "resultToStoreRate", "history"]


def _obj(*numbers: str, **other) -> dict:
    return {"object": {n: "number" for n in numbers} | other}


def _null(x) -> dict:
    return {"null": x}


def _one(*values: str) -> dict:
    return {"string": {"values": list(values)}}


def _check(name: str) -> dict:
    return {"string": {"check": name}}


def _each(keys: list[str], x) -> dict:
    return {"object": dict.fromkeys(keys, x)}


def digest_schema(version: str = VERSION) -> dict:
    maybe, day, text = _null("number"), _check("date"), "string"
    sampling = _null(_obj(status=_one("sampled", "unsampled", "unknown"), sampleShare=maybe, sampleSize=maybe, sampleSpace=maybe, dataLag=maybe))
    goals = _each(GOALS, _obj("users", "visits", "visitConversionRate", "userConversionRate"))
    state = {"object": {"status": _one("ok", "not_configured", "unavailable"), "diagnostic?": {"object": {"category": text, "httpStatus?": "number"}}}}
    clicks = ("clickEvents", "uniqueClickSessions")
    trend = _each(TRENDS, _obj("current", "previous", "absolute", percent=maybe))
    shared = {"array": _obj(*clicks, shareOfClicks=maybe)}
    named = lambda rows, **more: {"array": {"object": rows["array"]["object"] | more}}
    return {
        "object": {
            "version": _one(version), "kind": _one("daily", "weekly"), "logicalId": text, "generatedAt": _check("instant"), "asOfDate": day, "timezone": _one(ZONE), "status": _one("complete", "partial"),
            "sourceReport": {"object": {"version": text, "evidenceHash": _check("hash")}},
            "periods": _each(WINDOWS, {"object": {"startDate": day, "endDate": day}}),
            "sourceStatus": _each(["firstParty", "metrika", "acquisition"], state),
            "traffic": _each(WINDOWS, _null(_obj("users", "visits"))),
            "acquisition": {"object": {
                "last7Days": _null({"object": {"goals": goals}}), "last30Days": _null({"object": {"goals": goals}}),
                "sources30Days": {"array": _obj("users", "visits", source=text, label=text, goals=goals)}, "landingPages30Days": {"array": _obj("users", "visits", path=_check("path"), goals=goals)},
                "quizCompletionPolicy": _obj("yandexGoalId", authority=_one("first_party_ordered_funnel"), yandexStatus=_one("withheld_historical_contamination"), cleanFrom=day),
            }},
            "funnel": _each(WINDOWS, _obj("quizStartSessions", "quizCompletedSessions", "resultViewedSessions", "resultToStoreSessions", "storeClickSessions", quizCompletionRate=maybe, resultToStoreRate=maybe)),
            "commerce": {"object": {
                "windows": _each(WINDOWS, _obj(*clicks)), "merchants30Days": named(shared, merchant=_null(text)), "placements30Days": named(shared, value=_null(text)),
                "topBoards30Days": {"array": _obj(*clicks, boardSlug=text)}, "topOffers30Days": {"array": _obj(*clicks, offerSlug=text, source=_null(text), merchant=_null(text))},
            }},
            "trends": _each(["weekOverWeek", "monthOverMonth"], trend),
            "partnerReadiness": {"object": {
                "score": maybe, "status": _one("insufficient_data", "early", "building_evidence", "approaching", "metric_ready"), "strictOutreachReady": "boolean", "components": _each(PARTS, _obj("target", "maxPoints", value=maybe, points=maybe)),
                "thresholds": _obj("trafficUsers30d", "quizCompletedSessions30d", "storeClickSessions30d", "resultToStoreRate30d", "firstPartyHistoryDays"), "failingMetrics": {"array": text}, "manualChecks": {"array": {"object": {"id": text, "status": _one("NOT_OBSERVABLE")}}},
            }},
            "dataQuality": {"array": {"object": {"code": text, "severity": _one("info", "warning"), "message": text}}},
            "sampling": {"object": {"traffic": _each([*WINDOWS, "sources30Days"], sampling), "acquisition": _each(["last7Days", "last30Days", "sources30Days", "landingPages30Days"], sampling)}},
            "delivery": {"object": {"contentHash": _check("hash")}},
        }
    }


#: Places of a report that a digest has elsewhere, the longest first.
MOVED = [
    *[(f"$.traffic.{w}.sampling", f"$.sampling.traffic.{w}") for w in WINDOWS],
    *[(f"$.acquisition.{w}.sampling", f"$.sampling.acquisition.{w}") for w in ("last7Days", "last30Days")],
    ("$.acquisition.landingPagesSampling", "$.sampling.acquisition.landingPages30Days"),
    ("$.acquisition.sourcesSampling", "$.sampling.acquisition.sources30Days"),
    ("$.acquisition.sourceStatus", "$.sourceStatus.acquisition"),
    ("$.traffic.sourcesSampling", "$.sampling.traffic.sources30Days"),
    ("$.windows", "$.periods"),
]
#: Fields that a digest has by itself; a report's own are not taken over.
MADE = ["version", "kind", "logicalId", "generatedAt", "status", "sourceReport", "sampling", "periods", "delivery"]
EVIDENCE = ["asOfDate", "timezone", "periods", "sourceStatus", "traffic", "acquisition", "funnel", "commerce", "trends", "partnerReadiness", "dataQuality", "sampling"]


def _moved(path: Column) -> Column:
    out = path
    for old, new in reversed(MOVED):
        inside = (path == old) | F.startswith(path, F.lit(f"{old}.")) | F.startswith(path, F.lit(f"{old}["))
        out = F.when(inside, F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(out)
    return out


def _above(path: Column) -> Column:
    return F.regexp_replace(path, r"(?:\.[^.\[\]]+|\[\d*\])$", "")


def projected(levels: list[DataFrame], schema: DataFrame) -> DataFrame:
    """Nodes of the digest's evidence: listed places of the report, moved ones in their new place, samplings null where their source is.

    Keys with points or brackets are in no schema, so the places that stay have plain paths.
    """
    nodes = tree.together(levels).where(~F.coalesce(F.col("key").rlike(r"[.\[\]]"), F.lit(False)))
    report = nodes.where("depth > 0").where(~F.regexp_extract("pattern", r"^\$\.([^.\[]+)", 1).isin(MADE))
    moved = report.select("id", _moved(F.col("path")).alias("path"), _moved(F.col("pattern")).alias("pattern"), "key", "place", "kind", "text")
    flags = nodes.where("path in ('$.sourceStatus.metrika.status', '$.acquisition.sourceStatus.status')").groupBy(F.col("id").alias("_i")).agg(
        F.max(F.when(F.col("path") == "$.sourceStatus.metrika.status", F.col("text"))).alias("traffic_state"), F.max(F.when(F.col("path") == "$.acquisition.sourceStatus.status", F.col("text"))).alias("acquisition_state"))
    flags = flags.hint("merge")
    j = moved.join(flags, F.col("id") == F.col("_i"), "left")
    off = lambda state: ~F.coalesce(F.col(state) == "ok", F.lit(False))
    gone = (F.startswith("path", F.lit("$.sampling.traffic.sources30Days")) & off("traffic_state")) | (F.col("path").rlike(r"^\$\.sampling\.acquisition\.(?:sources|landingPages)30Days") & off("acquisition_state"))
    kept = j.where(~gone).select("id", "path", "pattern", "key", "place", "kind", "text")
    roots = nodes.where("depth = 0").select("id").join(flags, F.col("id") == F.col("_i"), "left")
    none, text = F.lit(None).cast("string"), F.lit
    make = lambda path, kind: F.struct(text(path).alias("path"), text(kind).alias("kind"))
    own = F.array_compact(F.array(
        make("$", "object"), make("$.sampling", "object"), make("$.sampling.traffic", "object"), make("$.sampling.acquisition", "object"), F.when(off("traffic_state"), make("$.sampling.traffic.sources30Days", "null")),
        *[F.when(off("acquisition_state"), make(f"$.sampling.acquisition.{n}30Days", "null")) for n in ("sources", "landingPages")],
    ))
    added = roots.select("id", F.explode(own).alias("m")).select("id", "m.path", F.col("m.path").alias("pattern"), none.alias("key"), F.lit(0).alias("place"), "m.kind", none.alias("text"))
    empty = moved.where("kind = 'null'").where(F.col("path").rlike(r"^\$\.(?:traffic|acquisition)\.[A-Za-z0-9]+$"))
    sampled = empty.select("id", F.concat(F.lit("$.sampling"), F.substring("path", F.lit(2), F.length("path"))).alias("path"), F.concat(F.lit("$.sampling"), F.substring("pattern", F.lit(2), F.length("pattern"))).alias("pattern"), none.alias("key"), "place", "kind", "text")
    every = kept.unionByName(added).unionByName(sampled)
    listed = every.join(F.broadcast(schema.select(F.col("pattern").alias("_s"))), F.col("pattern") == F.col("_s"), "left_semi")
    name = F.nullif(F.regexp_extract("path", r"\.([^.\[\]]+)$", 1), F.lit(""))
    depth = F.length(F.regexp_replace("path", r"[^.\[]", ""))
    return listed.select("id", depth.cast("int").alias("depth"), "path", F.nullif(_above(F.col("path")), F.lit("")).alias("parent"), "pattern", F.nullif(_above(F.col("pattern")), F.lit("")).alias("parent_pattern"), name.alias("key"), "place", "kind", "text")


def _object(fields: Column) -> Column:
    """A JSON object of (key, json) pairs in the order of their keys."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(fields), lambda f: F.concat(tree.quoted(f["key"]), F.lit(":"), f["json"])), ","), F.lit("}"))


def _hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def build_digests(reports: DataFrame, version: str = VERSION) -> DataFrame:
    """id, logical_id, status, evidence_hash, content_hash, digest (JSON) and problem of reports (id, kind: daily or weekly, json).

    A problem leaves the digest null: digest_schema_invalid (no JSON, another time zone, or faults by the schema),
    weekly_period_invalid, or digest_privacy_violation, which is named before faults of the schema.
    """
    spark, tables = reports.sparkSession, Rounds(reports.sparkSession, "digests")
    spec = digest_schema(version)
    schema = tree.schema_table(spark, spec)
    levels = tree.walk(reports.select("id", "json"), tables)
    nodes = tables.put(projected(levels, schema), "projected")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    tops = tree.written([nodes.where(F.col("depth") == n) for n in range(deepest + 1)], tables, down_to=min(1, deepest))
    fields = tops.where(F.col("key").isin(EVIDENCE)).groupBy(F.col("id").alias("_t")).agg(F.collect_list(F.struct("key", "json")).alias("fields"))
    top = tree.together(levels)
    said = lambda path: F.max(F.when((F.col("path") == path) & (F.col("kind") == "string"), F.col("text")))
    facts = {"report_version": "$.version", "generated": "$.generatedAt", "as_of": "$.asOfDate", "zone": "$.timezone", "a": "$.sourceStatus.firstParty.status", "b": "$.sourceStatus.metrika.status", "c": "$.acquisition.sourceStatus.status"}
    facts |= {f"{side}{n}": f"$.windows.{w}.{side}Date" for side in ("start", "end") for n, w in ((1, "last7Days"), (0, "previous7Days"))}
    found = top.groupBy(F.col("id").alias("_f")).agg(*[said(path).alias(name) for name, path in facts.items()])
    j = reports.join(fields.hint("merge"), F.col("id") == F.col("_t"), "left").join(found.hint("merge"), F.col("id") == F.col("_f"), "left")
    day = lambda c: strict_date(F.col(c))
    complete = F.lit(True)
    for c in "abc":
        complete = complete & F.coalesce(F.col(c) == "ok", F.lit(False))
    week = F.coalesce((F.weekday(day("as_of")) == 6) & (F.col("as_of") == F.col("end1")) & weeks_follow(day("start1"), day("end1"), day("start0"), day("end0")), F.lit(False))
    weekly = F.col("kind") == "weekly"
    j = j.withColumns({"status": F.when(complete, "complete").otherwise("partial"), "logical_id": F.when(weekly, F.concat(F.lit("weekly:"), iso_week(day("as_of")))).otherwise(F.concat(F.lit("daily:"), F.col("as_of"))), "week": ~weekly | week})
    pair = lambda key, json: F.struct(F.lit(key).alias("key"), json.alias("json"))
    word = lambda c: tree.quoted(F.col(c) if isinstance(c, str) else c)
    j = j.withColumn("evidence_hash", _hash(_object(F.array_append("fields", pair("sourceReportVersion", word("report_version"))))))
    source = _object(F.array(pair("evidenceHash", word("evidence_hash")), pair("version", word("report_version"))))
    head = F.array(pair("version", word(F.lit(version))), pair("kind", word("kind")), pair("logicalId", word("logical_id")), pair("status", word("status")), pair("sourceReport", source))
    j = j.withColumn("content", F.concat("fields", head)).withColumn("content_hash", _hash(_object(F.col("content"))))
    last = F.array(pair("generatedAt", F.coalesce(word("generated"), F.lit("null"))), pair("delivery", _object(F.array(pair("contentHash", word("content_hash"))))))
    j = j.withColumn("digest", _object(F.concat("content", last)))
    whole = tables.put(j.select("id", "logical_id", "status", "evidence_hash", "content_hash", "digest", "week", F.coalesce(F.col("zone") == ZONE, F.lit(False)).alias("here")), "digests")
    seen = tree.faults(whole.select("id", F.col("digest").alias("json")), spec).select(F.col("id").alias("_v"), "faults")
    out = whole.join(seen.hint("merge"), F.col("id") == F.col("_v"), "left")
    private = F.exists("faults", lambda x: F.startswith(x, F.lit("privacy:")))
    problem = F.when(F.col("digest").isNull() | ~F.col("here"), "digest_schema_invalid").when(~F.col("week"), "weekly_period_invalid").when(private, "digest_privacy_violation").when(F.size("faults") > 0, "digest_schema_invalid")
    fine = problem.isNull()
    return out.select("id", *[F.when(fine, F.col(c)).alias(c) for c in ("logical_id", "status", "evidence_hash", "content_hash", "digest")], problem.alias("problem"))
