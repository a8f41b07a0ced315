"""Store links and click payloads as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts of stores that links may lead to, with the store's name.
DESTINATIONS = {"trial-sport.ru": "Trial Sport", "www.trial-sport.ru": "Trial Sport", "traektoria.ru": "Траектория", "www.traektoria.ru": "Траектория"}
SEARCH = "https://trial-sport.ru/search/?q="
PARAMETERS = {"source": "from", "placement": "placement", "size_cm": "sizeCm", "size_label": "sizeLabel", "source_size_label": "sourceSizeLabel", "width_type": "widthType"}


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))


def store_name(url: Column) -> Column:
    """The store behind a link, null for any other."""
    out = F.lit(None).cast("string")
    for h, name in DESTINATIONS.items():
        out = F.when(host(url) == h, name).otherwise(out)
    return out


def destination(url: Column, saved: Column) -> Column:
    """Struct of mode (saved, direct or fallback-search) and merchant."""
    known = store_name(url)
    mode = F.when(saved, "saved").when(known.isNotNull(), "direct").otherwise("fallback-search")
    return F.struct(mode.alias("mode"), F.when(mode == "direct", known).when(mode == "fallback-search", F.lit("Trial Sport")).alias("merchant"))


def search_url(query: Column) -> Column:
    years = F.regexp_replace(F.coalesce(query, F.lit("")), r"(?<![A-Za-z0-9_])20\d{2}(?:/20\d{2})?(?![A-Za-z0-9_])", " ")
    words = F.regexp_replace(years, r"(?i)(?<![A-Za-z0-9_])snowboard(?![A-Za-z0-9_])", " ")
    return F.concat(F.lit(SEARCH), F.url_encode(F.trim(F.regexp_replace(words, r"(?U)\s+", " "))))


def store_url(affiliate: Column, brand: Column, model: Column) -> Column:
    return F.when(store_name(affiliate).isNotNull(), affiliate).otherwise(search_url(F.concat_ws(" ", brand, model)))


def redirect_href(slug: Column, **values: Column) -> Column:
    """/go/<slug> with a query of the values that are not null or blank, in a fixed order."""
    parts = [F.when(F.length(values[k].cast("string")) > 0, F.concat(F.lit(f"{name}="), F.url_encode(values[k].cast("string")))) for k, name in PARAMETERS.items() if k in values]
    query = F.concat_ws("&", *parts)
    return F.concat(F.lit("/go/"), slug, F.when(F.length(query) > 0, F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def click_payload(**values: Column) -> Column:
    """The JSON payload of a store click; missing values are written as null, a missing source as ``unknown``."""
    fields = ["board_slug", "offer_slug", "destination_url", "source", "placement", "size_cm", "size_label", "source_size_label", "width_type"]
    have = {k: values.get(k, F.lit(None).cast("string")) for k in fields}
    have["source"] = F.coalesce(have["source"], F.lit("unknown"))
    return F.to_json(F.struct(*[v.alias(k) for k, v in have.items()]), {"ignoreNullFields": "false"})


def redirect_slug(href: Column) -> Column:
    """The offer of an internal /go/<slug> link, null for others."""
    return F.try_url_decode(F.nullif(F.regexp_extract(href, r"^/go/([^/?#]+)(?:[?#].*)?$", 1), F.lit("")))
