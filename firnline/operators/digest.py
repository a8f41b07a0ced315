"""Report digests: canonical hashes, privacy of what is sent, warnings about the data."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Keys (letters and digits, lower case) that no digest may hold.
FORBIDDEN = {"sessionid", "userid", "visitorid", "email", "phone", "name", "height", "heightcm", "weight", "weightkg", "bootsize", "bootsizeeu", "stance", "destinationurl", "url", "payload", "rawpayload", "rawquizpayload", "quizanswers", "authorization", "authorizationheader", "token", "oauthtoken", "secret", "password", "cookie", "databaseurl", "cronsecret", "resendapikey", "recipient", "sender"}
LEAKS = {"full_url": r"(?i)^https?://", "database_url": r"(?i)^postgres(ql)?://", "email_value": r"^[^\s@]+@[^\s@]+\.[^\s@]+$", "authorization_value": r"(?i)^bearer\s+\S+"}


def _finite(x) -> None:
    if isinstance(x, float) and not math.isfinite(x):
        raise ValueError("a number is not finite")
    for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        _finite(v)


def _number(x: float | int) -> str:
    """A number as ECMAScript writes it: the shortest digits, whole numbers without a point, exponents from 1e21 on."""
    if isinstance(x, int):
        x = float(x)
    if x == 0:
        return "0"
    sign, body = ("-", repr(-x)) if x < 0 else ("", repr(x))
    digits, _, exponent = body.partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    ds = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    ds = ds.rstrip("0") or "0"
    n = len(ds)
    if n <= point <= 21:
        return sign + ds + "0" * (point - n)
    if 0 < point <= 21:
        return sign + ds[:point] + "." + ds[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + ds
    e = point - 1
    return sign + ds[0] + ("." + ds[1:] if n > 1 else "") + "e" + ("+" if e > 0 else "-") + str(abs(e))


def _units(key: str) -> bytes:
    """Order by UTF-16 units, which differs from that by code point beyond U+FFFF."""
    return key.encode("utf-16-be", "surrogatepass")


def canonical(value, order=_units) -> str:
    """JSON with keys in order of their UTF-16 units and no spaces, numbers as ECMAScript writes them; none but finite ones."""
    _finite(value)

    def text(x) -> str:
        if isinstance(x, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{text(x[k])}" for k in sorted(x, key=order)) + "}"
        if isinstance(x, list):
            return "[" + ",".join(map(text, x)) + "]"
        return _number(x) if isinstance(x, int | float) and not isinstance(x, bool) else json.dumps(x, ensure_ascii=False)

    return text(value)


def by_letters(key: str) -> tuple:
    """The English dictionary order of ASCII keys: signs, digits, letters; lower case before upper only where all else is equal."""
    rank = lambda c: (2, c.lower()) if c.isalpha() else (1, c) if c.isdigit() else (0, c)
    return [rank(c) for c in key], [c.isupper() for c in key]


def _hashed(text: str | None, order) -> str | None:
    """Null for a text that is not JSON, or holds a number that is not finite."""
    try:
        return None if text is None else "sha256:" + hashlib.sha256(canonical(json.loads(text), order).encode("utf-8", "surrogatepass")).hexdigest()
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical_hash(x: pd.Series) -> pd.Series:
    """sha256 of the canonical form of a JSON text; key order and spacing do not matter. Null for null and malformed texts."""
    return x.map(lambda t: _hashed(t, _units))


@F.pandas_udf(StringType())
def plan_hash(x: pd.Series) -> pd.Series:
    """The same with keys in dictionary order, by which plans are identified."""
    return x.map(lambda t: _hashed(t, by_letters))


def violations_of(value, path: str = "$") -> list[str]:
    if isinstance(value, str):
        return [f"privacy:{path}:{kind}" for kind, pattern in LEAKS.items() if re.match(pattern, value.strip())]
    out: list[str] = []
    if isinstance(value, list):
        for i, v in enumerate(value):
            out += violations_of(v, f"{path}[{i}]")
    if isinstance(value, dict):
        for k, v in value.items():
            if re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKC", k).lower()) in FORBIDDEN:
                out.append(f"privacy:{path}.{k}:forbidden_key")
            out += violations_of(v, f"{path}.{k}")
    return out


def _violations(text: str | None) -> list[str] | None:
    try:
        return None if text is None else sorted(set(violations_of(json.loads(text))))
    except ValueError:
        return ["privacy:$:not_json"]


@F.pandas_udf(ArrayType(StringType()))
def privacy_violations(x: pd.Series) -> pd.Series:
    """Sorted violations in a JSON text, at any depth."""
    return x.map(_violations)


def schema_gaps(df: DataFrame, expected) -> list[str]:
    """Columns of a frame that are missing, unknown or of another type than a StructType says."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in expected}
    return sorted([f"missing:{c}" for c in want.keys() - have.keys()] + [f"unknown:{c}" for c in have.keys() - want.keys()] + [f"type:{c}" for c in want.keys() & have.keys() if have[c] != want[c]])


def with_optional_columns(df: DataFrame, expected) -> DataFrame:
    """The frame with absent columns of a StructType as typed nulls, in its order."""
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in expected])


#: Rows that one group of a checksum holds, about.
GROUP_ROWS = 1 << 16


def checksum(df: DataFrame, key: str) -> DataFrame:
    """rows and md5 over all rows in key order: row hashes are hashed together per prefix of the key's hash first.

    Equal tables have equal checksums whatever their partitions are: the number of groups depends on the rows alone.
    Beyond 4,096 groups the prefix gets longer, and the hashes of long prefixes are hashed by shorter ones, so that no
    group, in any round, holds more than about ``GROUP_ROWS`` hashes; rows that share a key stay in one group.
    """
    row = F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])))
    parts = df.select(F.md5(F.col(key).cast("string")).alias("p"), F.col(key).cast("string").alias("k"), row.alias("h"), F.lit(1).cast("long").alias("n"))
    digits, count = 3, df.count()
    while count > GROUP_ROWS * 16**digits:
        digits += 3
    together = lambda c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "h"))), lambda x: x["h"]), "").cast("binary"))
    order = "k"
    for d in range(digits, 0, -3):
        parts, order = parts.groupBy(F.substring("p", 1, d).alias("p")).agg(F.sum("n").alias("n"), together(order).alias("h")), "p"
    return parts.agg(F.sum("n").alias("rows"), together("p").alias("md5"))


def warnings(history: DataFrame, funnel: DataFrame, commerce: DataFrame, top: DataFrame, sources: dict[str, str] | None = None, traffic: DataFrame | None = None) -> DataFrame:
    """code and severity of what a reader of the report should know; exact offers count over the listed top alone.

    ``sources`` has the status (ok, not_configured, unavailable) of first_party, metrika and acquisition where one is not
    ok; ``traffic`` one row with users and visits of the last 30 days.
    """
    state = {"first_party": "ok", "metrika": "ok", "acquisition": "ok"} | (sources or {})
    missing = lambda name: state[name] if state[name] in ("ok", "not_configured") else "unavailable"
    k = F.lit(1).alias("k")
    h = history.select("*", k)
    f = funnel.agg(F.bool_or(F.col("quiz_completed_sessions") > F.col("quiz_start_sessions")).alias("a"), F.bool_or(F.col("result_to_store_sessions") > F.col("result_viewed_sessions")).alias("b")).select("*", k)
    is_total = (F.col("kind") == "total") & (F.col("window_key") == "last30Days")
    c = commerce.agg(F.max(F.when(is_total, F.col("event_count"))).alias("clicks"), F.max(F.when((F.col("kind") == "merchant") & F.col("group_value").isNull(), F.col("event_count"))).alias("unknown")).select("*", k)
    t = top.agg(F.coalesce(F.sum(F.when(F.col("kind") == "offer", F.col("event_count"))), F.lit(0)).alias("exact")).select("*", k)
    rules = [
        ("legacy_payload_string_encoding", "info", F.col("legacy_payload_rows") > 0),
        ("invalid_payload_rows", "warning", F.col("invalid_payload_rows") > 0),
        ("insufficient_history", "warning", F.col("history_days") < 60),
        ("quiz_completion_exceeds_starts", "warning", F.col("a")),
        ("result_to_store_exceeds_views", "warning", F.col("b")),
        ("incomplete_exact_offer_provenance", "info", (F.col("clicks") > 0) & (F.col("exact") < F.col("clicks"))),
        ("unknown_merchant_dominance", "warning", F.col("unknown") / F.nullif(F.col("clicks"), F.lit(0)) >= 0.5),
        *[(f"{name}_{missing(name)}", "warning", F.lit(True)) for name in ("first_party", "metrika") if missing(name) != "ok"],
        *([("metrika_acquisition_unavailable", "warning", F.lit(True))] if state["metrika"] == "ok" and state["acquisition"] == "unavailable" else []),
        ("metrika_users_without_visits", "warning", (F.col("users") > 0) & (F.col("visits") == 0)),
    ]
    rows = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for code, level, when in rules]))
    v = (traffic.select("users", "visits") if traffic is not None else history.limit(1).select(F.lit(None).cast("long").alias("users"), F.lit(None).cast("long").alias("visits"))).select("*", k)
    return h.join(f, "k").join(c, "k").join(t, "k").join(v, "k").select(F.explode(rows).alias("w")).select("w.*")


def token_hash(token: Column) -> Column:
    return F.when(token.rlike("^[A-Za-z0-9_-]{43}$"), F.concat(F.lit("sha256:"), F.sha2(token, 256)))
