"""Text, number and identity normalisers of catalogue feeds."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Latin spelling of Cyrillic letters.
LATIN = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya"}
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&quot;": '"', "&#039;": "'", "&lt;": "<", "&gt;": ">"}
#: Word edges as in ASCII dialects: Cyrillic letters are no word characters.
EDGE_L, EDGE_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def space(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s   -     　﻿]+", " "))


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def blank_to_null(x: Column) -> Column:
    return F.nullif(space(x), F.lit(""))


def transliterate(x: Column) -> Column:
    out = x
    for k, v in LATIN.items():
        if len(v) != 1:
            out = F.replace(F.replace(out, F.lit(k), F.lit(v)), F.lit(k.upper()), F.lit(v))
    single = {k: v for k, v in LATIN.items() if len(v) == 1}
    return F.translate(out, "".join(single) + "".join(single).upper(), "".join(single.values()) * 2)


def _bounded(pattern: str) -> str:
    return f"{EDGE_L}(?:{pattern}){EDGE_R}"


def slug(x: Column, years: bool = True) -> Column:
    """A name as a part of an address. Years are left out, unless ``years`` says that such numbers are parts of names."""
    out = F.lower(transliterate(F.coalesce(x, F.lit(""))))
    for pattern in (r"(?:fw|ss)\d{2}", r"20\d{2}(?:/20\d{2})?" if years else r"20\d{2}/20\d{2}", "snowboard|snoubord"):
        out = F.regexp_replace(out, _bounded(pattern), " ")
    out = F.regexp_replace(F.replace(F.replace(F.regexp_replace(out, "['’]", ""), F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" plus ")), "[^a-z0-9]+", "-")
    return F.regexp_replace(out, "^-+|-+$", "")


def board_key(x: Column, years: bool = True) -> Column:
    return F.replace(slug(x, years), F.lit("-"), F.lit(""))


def decode_html(x: Column) -> Column:
    out = F.coalesce(x, F.lit(""))
    for k, v in ENTITIES.items():
        out = F.regexp_replace(out, f"(?i){k}", v)
    return space(out)


def strip_html(x: Column) -> Column:
    return decode_html(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", " "))


def _year(x: Column) -> Column:
    n = x.cast("string").try_cast("int")
    return F.when(n.between(2000, 2100), n).when(n.between(20, 40), n + 2000)


def _found(x: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


FULL, MIXED, SHORT = (_bounded(p) for p in (r"(20\d{2})\s*[/-]\s*(20\d{2})", r"(20\d{2})\s*[/-]\s*(\d{2})", r"(\d{2})\s*[/-]\s*(\d{2})"))
WINTER, YEAR = f"(?i){EDGE_L}FW\\s*['’]?\\s*(\\d{{2}}|20\\d{{2}}){EDGE_R}", _bounded(r"(20\d{2})")


def _season(t: Column, winter: bool) -> Column:
    pair = lambda a, b: F.concat_ws("/", a.cast("string"), b.cast("string"))
    full = F.when(t.rlike(FULL), pair(_found(t, FULL, 1), _found(t, FULL, 2)))
    mixed = let(_year(_found(t, MIXED, 2)), lambda end: F.when(end.isNotNull(), pair(_found(t, MIXED, 1), end)))
    short = let(F.struct(_year(_found(t, SHORT, 1)).alias("a"), _year(_found(t, SHORT, 2)).alias("b")), lambda y: F.when(y["b"] >= y["a"], pair(y["a"], y["b"])))
    fw = let(_year(_found(t, WINTER, 1)), lambda end: F.when(end.isNotNull(), pair(end - 1, end)))
    single = let(_found(t, YEAR, 1), lambda y: F.when(y.isNotNull(), pair(y.cast("int") - 1, y)) if winter else y)
    return F.coalesce(full, mixed, short, fw, single)


def season_label(x: Column, winter: bool = False) -> Column:
    """A season as first/last year or one year; rules in order of how much they say. ``winter`` makes a single year the end of a season."""
    return let(space(x), lambda t: _season(t, winter))


def season_identity(x: Column) -> Column:
    spaced = r"^(20\d{2})\s+(20\d{2})$"
    return let(blank_to_null(x), lambda t: F.when(t.rlike(spaced), F.regexp_replace(t, spaced, "$1/$2")).otherwise(F.coalesce(_season(t, True), t)))


def season_rank(x: Column) -> Column:
    pattern = _bounded(r"(20\d{2})/(20\d{2})")
    return let(space(x), lambda t: F.when(t.rlike(pattern), _found(t, pattern, 2).cast("int") * 10000 + _found(t, pattern, 1).cast("int")).otherwise(_found(t, YEAR, 1).cast("int")))


def whole_number(x: Column) -> Column:
    """The number that starts the digits and signs of a text."""
    return _found(F.regexp_replace(x.cast("string"), r"[^0-9-]", ""), r"^(-?\d+)", 1).try_cast("long")


def decimal_number(x: Column) -> Column:
    """A decimal, the first comma read as a point, from whatever prefix is a number."""
    t = F.regexp_replace(F.concat(F.regexp_replace(x.cast("string"), r"^([^,]*),", "$1.")), r"[^0-9.+-]", "")
    return _found(t, r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")


def waist_mm(x: Column) -> Column:
    n = decimal_number(x)
    return F.floor(F.when(n.between(1000, 4000), n / 10).when((n > 0) & (n < 100), n * 10).otherwise(n) + 0.5).cast("int")


def plausible_waist(cm: Column, mm: Column) -> Column:
    return F.coalesce(F.when(cm >= 140, mm.between(200, 340)).when(cm >= 100, mm.between(170, 340)).otherwise(mm.between(120, 240)), F.lit(False))


def _has(t: Column, *words: str) -> Column:
    out = F.contains(t, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(t, F.lit(w))
    return out


def flex_number(x: Column) -> Column:
    named = let(F.lower(space(x)), lambda t: F.when(_has(t, "мяг"), 3).when(_has(t, "сред"), 5).when(_has(t, "жест"), 8).otherwise(5))
    return let(decimal_number(x), lambda n: F.when(n.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), F.floor(n + 0.5)))).otherwise(named)).cast("int")


def board_line(x: Column) -> Column:
    t = F.lower(space(x))
    return F.when(_has(t, "жен"), "women").when(_has(t, "муж"), "men").otherwise("unisex")


def shape(x: Column) -> Column:
    t = F.lower(space(x))
    both = lambda a, b: _has(t, a) & _has(t, b)
    return (
        F.when(_has(t, "asym"), "asym-twin")
        .when(_has(t, "directional twin") | both("направлен", "твин"), "directional-twin")
        .when(_has(t, "tapered directional") | both("directional", "taper"), "tapered-directional")
        .when(_has(t, "true twin") | (t == "twin"), "twin")
        .when(_has(t, "directional", "направлен"), "directional")
        .when(_has(t, "twin", "твин"), "twin")
    )


def riding_style(x: Column) -> Column:
    t = F.lower(space(x))
    free, park, every = _has(t, "freeride", "фрирайд"), _has(t, "park", "фристайл", "freestyle"), _has(t, "all mountain", "all-mountain", "универс")
    return F.when(free & ~park & ~every, "freeride").when(park & ~free & ~every, "park").otherwise("all-mountain")


def skill_level(x: Column, flex: Column) -> Column:
    t = F.lower(space(x))
    return F.when(_has(t, "начина"), "beginner").when(_has(t, "эксперт"), "advanced").when(_has(t, "продвин"), "intermediate").when(flex >= 8, "advanced").when(flex <= 4, "beginner").otherwise("intermediate")


def weight_range(x: Column) -> Column:
    """Struct of low and high (null: open) from texts like 60+, 60-80 and 60."""
    n = r"(\d+(?:[.,]\d+)?)"
    plus, span = rf"{n}\s*[-–]?\s*{n}?\+", rf"{n}\s*[-–]\s*{n}"

    def read(t: Column) -> Column:
        whole = lambda p, g: F.floor(decimal_number(_found(t, p, g)) + 0.5).cast("int")
        alone = F.floor(decimal_number(t) + 0.5).cast("int")
        low = F.when(t.rlike(plus), whole(plus, 1)).when(t.rlike(span), whole(span, 1)).otherwise(F.coalesce(alone, F.lit(0)))
        return F.struct(low.alias("low"), F.when(t.rlike(plus), whole(plus, 2)).when(t.rlike(span), whole(span, 2)).alias("high"))

    return let(F.lower(space(x)), read)


def size_cm(x: Column) -> Column:
    return F.replace(_found(space(x), r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")


def size_key(x: Column) -> Column:
    t = F.regexp_replace(F.replace(F.lower(space(x)), F.lit("см"), F.lit("cm")), r"\s+", "")
    return F.regexp_replace(t, "cm$", "")


def split_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\|"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "да"), F.lit(False))


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no function for it."""
    return x.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def _identity(compatible: Column) -> Column:
    t = F.regexp_replace(F.lower(compatible), "[’']", "")
    t = F.replace(F.replace(t, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" plus "))
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def identity_text(x: Column) -> Column:
    """Words of letters and digits of a name, lower-cased, with & and + spelt out."""
    return _identity(nfkc(space(x)))


def season_text(x: Column) -> Column:
    """The identity of a season as words; null without one."""
    return _identity(season_identity(nfkc(x)))


def family_brand(x: Column) -> Column:
    return F.lower(nfkc(space(x)))


def family_model(x: Column) -> Column:
    t = F.regexp_replace(F.lower(nfkc(space(x))), "[’']", "")
    t = F.replace(F.replace(t, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" plus "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[‐‑‒–—\-._()/\\,;:!?]+", " "), r"\s+", " "))


def family_season(x: Column) -> Column:
    def read(t: Column) -> Column:
        pair = lambda p, a, b: F.when(t.rlike(p), F.concat(F.lit(a), _found(t, p, 1), F.lit("/"), F.lit(b), _found(t, p, 2)))
        return F.coalesce(pair(FULL, "", ""), pair(MIXED, "", "20"), pair(SHORT, "20", "20"), F.lower(t))

    return let(blank_to_null(x), read)


def width_marker(model: Column) -> Column:
    """Struct of kind and base (the name without its width marker) of a normalised model name."""
    rules = [("ambiguous-mid-wide", r"^(.+?)\s+mid\s+wide(?:\s+snowboard)?$"), ("explicit-wide", r"^(.+?)\s+wide(?:\s+snowboard)?$"), ("ambiguous-single-w", r"^(.+?)\s+w$"), ("ambiguous-size-w", r"^(.+?)\s+\d{2,3}(?:\s+\d+)?w$")]

    def read(t: Column) -> Column:
        kind, base = F.lit("base"), t
        for name, pattern in reversed(rules):
            kind, base = F.when(t.rlike(pattern), name).otherwise(kind), F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)).otherwise(base)
        return F.struct(kind.alias("kind"), base.alias("base"))

    return let(model, read)
