"""Matching names to spec groups where one key contains the other, either way round.

A key that lies in another shares all its runs of three letters with it, so also its rarest one. Each side's keys are
listed under all their runs, and the other side asks under its rarest alone; what meets is then compared as a whole.
That finds every pair that a comparison of all keys with all would, and a key meets only keys that share its rarest run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.text import identity_text, let

GRAM = 3
# Words of an audience and of what a model's name must not lose.
WOMEN = ["women", "womens", "wmns", "woman", "female", "lady", "ladies", "girl", "girls"]
YOUTH = ["kid", "kids", "junior", "mini", "youth", "yunior", "yuniorsk"]


def protected_signature(name: Column) -> Column:
    """What a name says of width, audience and make; names that differ in it are different boards. JSON with fixed keys."""

    def read(t: Column) -> Column:
        words = F.filter(F.split(t, " "), lambda w: w != "")
        has = lambda *ws: F.arrays_overlap(words, F.lit(list(ws)))
        bare = F.trim(F.regexp_replace(t, r"(?<![a-z0-9_])(?:mid wide|wide|w)(?: snowboard|board)?$", ""))
        last = F.try_element_at(F.filter(F.split(bare, " "), lambda w: w != ""), F.lit(-1))
        width = F.when(t.rlike(r"(?<![a-z0-9_])mid wide(?![a-z0-9_])"), "mid-wide").when(has("wide", "w"), "wide").otherwise("base")
        audience = F.when(has(*WOMEN), "women").when(has(*YOUTH), "youth").otherwise("adult")
        make = F.array_compact(F.array(F.when(has("pro"), "pro"), F.when(last == "plus", "plus"), F.when(has("limited", "ltd"), "limited"), *[F.when(has(w), w) for w in ("carbon", "raw", "split")]))
        return F.to_json(F.struct(width.alias("width"), audience.alias("audience"), make.alias("make")))

    return let(identity_text(name), read)


def _runs(key: Column, n: int) -> Column:
    """Every run of n letters; the whole key if it has fewer."""
    at = F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(1)))
    return F.transform(at, lambda i: F.substring(key, i, F.lit(n)))


def _grams(key: Column) -> Column:
    """All runs of one to ``GRAM`` letters of a key, each once."""
    return F.array_distinct(F.concat(*[_runs(key, n) for n in range(1, GRAM + 1)]))


def _asked(key: Column) -> Column:
    """The runs under which a key may ask: those of ``GRAM`` letters, or the whole key if it is shorter."""
    return F.array_distinct(_runs(key, GRAM))


def _meetings(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """book, inner, outer: pairs of keys of one book (columns book and key) of which ``inner`` lies in ``outer``."""
    listed = outer.select("book", F.col("key").alias("outer"), F.explode(_grams(F.col("key"))).alias("gram"))
    often = listed.groupBy("book", "gram").agg(F.count(F.lit(1)).alias("n"))
    runs = inner.select("book", F.col("key").alias("inner"), F.explode(_asked(F.col("key"))).alias("gram"))
    # a run that no other key has finds nothing, and so does its key
    rarest = runs.join(often, ["book", "gram"], "left").groupBy("book", "inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("book", "inner", "r.gram")
    return rarest.join(listed, ["book", "gram"]).where(F.contains("outer", F.col("inner"))).select("book", "inner", "outer")


def matched_groups(names: DataFrame, groups: DataFrame) -> DataFrame:
    """book, key, signature, kind (exact, safe-partial, ambiguous or none), group (a key of the book) and candidates.

    ``names`` and ``groups`` have book, key (letters and digits) and signature; a group's key is unique in its book. An
    equal key wins. Else the groups count whose key contains the name's or lies in it and whose signature is the same;
    one is a match, several are none. An empty key lies in every key, so it has all groups of its signature as
    candidates. Repeated names give one row; a book without groups gives none.
    """
    asked = names.select("book", "key", "signature").where("key is not null").distinct()
    have = groups.select("book", F.col("key").alias("group"), F.col("signature").alias("_sig"))
    exact = asked.join(have, (asked.book == have.book) & (F.col("key") == F.col("group"))).select(asked.book, "key", "signature", "group")
    rest = asked.join(exact.select("book", "key").distinct(), ["book", "key"], "left_anti")
    full, keys = rest.where("key <> ''").select("book", "key").distinct(), groups.where("key <> ''").select("book", "key").distinct()
    inside = _meetings(full, keys).select("book", F.col("inner").alias("key"), F.col("outer").alias("group"))
    around = _meetings(keys, full).select("book", F.col("outer").alias("key"), F.col("inner").alias("group"))
    empty = rest.where("key = ''").select("book", "key").distinct().join(groups.select("book", F.col("key").alias("group")), "book")
    nameless = full.join(groups.where("key = ''").select("book", F.col("key").alias("group")), "book")
    met = inside.unionByName(around).unionByName(empty).unionByName(nameless).distinct()
    fits = rest.join(met, ["book", "key"]).join(have, ["book", "group"]).where(F.col("signature") == F.col("_sig"))
    counted = fits.groupBy("book", "key", "signature").agg(F.count(F.lit(1)).alias("candidates"), F.min("group").alias("group"))
    partial = rest.join(counted, ["book", "key", "signature"], "left").select(
        "book", "key", "signature", F.when(F.col("candidates") == 1, "safe-partial").when(F.col("candidates") > 1, "ambiguous").otherwise("none").alias("kind"),
        F.when(F.col("candidates") == 1, F.col("group")).alias("group"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    return exact.select("book", "key", "signature", F.lit("exact").alias("kind"), "group", F.lit(1).cast("long").alias("candidates")).unionByName(partial)
