"""Merging new rows into stored tables: the next state of a table as a frame, to be written beside the old one.

Parquet has no update in place. Each function returns the whole next table; ``swap`` writes it to a new path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, key: str, keep: list[str] = (), coalesced: list[str] = (), any_true: list[str] = ()) -> DataFrame:
    """Stored rows with those of ``new`` put over them by key.

    ``keep`` columns hold their stored value where there is one (ids, creation times), ``coalesced`` ones take the
    new value unless it is null, ``any_true`` ones are true once either is; all others take the new value. A null key
    never matches. ``new`` must hold each key once.
    """
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns], F.lit(True).alias("_new"))
    s = stored.withColumn("_old", F.lit(True))
    joined = s.join(n, F.col(key) == F.col(f"_n_{key}"), "full_outer")

    def value(c: str):
        if f"_n_{c}" not in n.columns:
            return F.col(c)
        fresh, old = F.col(f"_n_{c}"), F.col(c)
        if c in keep:
            return F.coalesce(old, fresh)
        if c in coalesced:
            return F.coalesce(fresh, old)
        if c in any_true:
            return F.coalesce(fresh, F.lit(False)) | F.coalesce(old, F.lit(False))
        return F.when(F.col("_new"), fresh).otherwise(old)

    return joined.select(*[value(c).alias(c) for c in stored.columns])


def replace_children(stored: DataFrame, new: DataFrame, parent: str, touched: DataFrame) -> DataFrame:
    """Child rows with all those of the touched parents replaced by the new ones."""
    kept = stored.join(touched.select(F.col(parent).alias("_t")).distinct(), F.col(parent) == F.col("_t"), "left_anti")
    return kept.unionByName(new)


def update_where(stored: DataFrame, changes: DataFrame, key: str, guard, columns: list[str]) -> DataFrame:
    """Stored rows with ``columns`` taken from ``changes`` where the guard (over stored columns) holds."""
    c = changes.select(F.col(key).alias("_k"), *[F.col(x).alias(f"_c_{x}") for x in columns])
    hit = F.col("_k").isNotNull() & F.coalesce(guard, F.lit(False))
    joined = stored.join(c, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.when(hit, F.col(f"_c_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in stored.columns])


def upsert_counts(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: how many rows of ``new`` an upsert inserts and updates, and how many stored ones it leaves alone."""
    joined = stored.select(F.col(key).alias("_s")).join(new.select(F.col(key).alias("_n")), F.col("_s") == F.col("_n"), "full_outer")
    return joined.agg(F.count_if(F.col("_s").isNull()).alias("inserted"), F.count_if(F.col("_s").isNotNull() & F.col("_n").isNotNull()).alias("updated"), F.count_if(F.col("_n").isNull()).alias("kept"))


def delete_where(stored: DataFrame, doomed: DataFrame, key: str, guard=None, unless: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that stay and those that go: keys in ``doomed``, with the guard true, and not used in ``unless``.

    Count the second frame for the number of deleted rows.
    """
    ids = doomed.select(F.col(key).alias("_k")).distinct()
    if unless is not None:
        ids = ids.join(unless.select(F.col(key).alias("_u")), F.col("_k") == F.col("_u"), "left_anti")
    marked = stored.join(ids, F.col(key) == F.col("_k"), "left").withColumn("_go", F.col("_k").isNotNull() & F.coalesce(guard if guard is not None else F.lit(True), F.lit(False)))
    return marked.where("not _go").drop("_k", "_go"), marked.where("_go").drop("_k", "_go")


def changed(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and columns (names, in order) of the rows whose values differ, and of rows that are on one side alone."""
    a, b = (df.select(F.col(key).alias(f"_{s}"), *[F.col(c).alias(f"_{s}_{c}") for c in columns], F.lit(True).alias(f"_in_{s}")) for df, s in ((before, "a"), (after, "b")))
    joined = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    other = F.array_compact(F.array(*[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in columns]))
    kind = F.when(F.col("_in_a").isNull(), "inserted").when(F.col("_in_b").isNull(), "removed").otherwise("changed")
    return joined.select(F.coalesce("_a", "_b").alias(key), kind.alias("kind"), other.alias("columns")).where((F.col("kind") != "changed") | (F.size("columns") > 0))


def normalized_galleries(stored: DataFrame, column: str = "gallery_images") -> DataFrame:
    """The rows whose gallery (an array or its JSON text) has blanks or outer spaces, with the clean array; others are left out."""
    kind = dict(stored.dtypes)[column]
    raw = F.from_json(F.col(column), "array<string>") if kind == "string" else F.col(column)
    clean = F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return stored.withColumn("_clean", clean).where(~F.col("_clean").eqNullSafe(raw)).withColumn(column, F.col("_clean")).drop("_clean")


def partition_changes(stored: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """key and kind: what an import inserts and updates, and which active stored rows it would make inactive."""
    s = stored.select(F.col(key).alias("_s"), F.coalesce("is_active", F.lit(True)).alias("_live"))
    joined = s.join(imported.select(F.col(key).alias("_n")).distinct(), F.col("_s") == F.col("_n"), "full_outer")
    kind = F.when(F.col("_s").isNull(), "insert").when(F.col("_n").isNotNull(), "update").when(F.col("_live"), "inactivate")
    return joined.select(F.coalesce("_s", "_n").alias(key), kind.alias("kind")).where("kind is not null")


def merged_import(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported products by slug, with what a stored one knows better.

    A draft gives its line where the import has no evidence of one, and its season where the import has none. A verified
    product keeps itself but for price, link, season where it has none, and activity, unless line or season contradict.
    """
    columns = [c for c in imported.columns if c != "line_evidence"]
    e = stored.select(*[F.col(c).alias(f"_e_{c}") for c in {*columns, "data_status"} if c in stored.columns])
    j = imported.join(e, F.col("slug") == F.col("_e_slug"), "left")
    old, new = lambda c: F.col(f"_e_{c}"), F.col
    season = lambda x: F.nullif(F.trim(x), F.lit(""))
    verified = F.coalesce(old("data_status") == "verified", F.lit(False))
    apart = F.coalesce(old("board_line") != new("board_line"), F.lit(False)) | F.coalesce(season(old("season_label")) != season(new("season_label")), F.lit(False))
    draft, keep = old("slug").isNotNull() & ~verified, verified & ~apart
    placeholder = F.coalesce(new("affiliate_url").rlike(r"(?i)example\.(com|org|net)"), F.lit(False)) | (F.coalesce(F.length(F.trim("affiliate_url")), F.lit(0)) == 0)
    rules = {
        "board_line": F.when(draft & (new("line_evidence") == "missing") & old("board_line").isin("men", "women"), old("board_line")).otherwise(F.when(keep, old("board_line")).otherwise(new("board_line"))),
        "season_label": F.when(draft, F.coalesce(season(new("season_label")), season(old("season_label")))).when(keep, F.coalesce(season(old("season_label")), season(new("season_label")))).otherwise(new("season_label")),
        "price_from": F.when(keep & ~F.coalesce(new("price_from") > 0, F.lit(False)), old("price_from")).otherwise(new("price_from")),
        "affiliate_url": F.when(keep & placeholder, old("affiliate_url")).otherwise(new("affiliate_url")),
        "is_active": new("is_active"),
    }
    other = lambda c: F.when(keep, old(c)).otherwise(new(c)) if c in stored.columns else new(c)
    return j.select(*[rules.get(c, other(c)).alias(c) for c in columns])


def swap(df: DataFrame, path: str, version: str) -> str:
    """Writes the next state to a path of its own and names it; readers move over when they take the name."""
    out = f"{path.rstrip('/')}/{version}"
    df.write.mode("errorifexists").parquet(out)
    return out
