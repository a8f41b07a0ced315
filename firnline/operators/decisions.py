"""Choosing three of a rider's recommendations: a steady, a wide and a lively one, each board once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PICKS = ["steady-choice", "width-choice", "playful-choice"]


def _first(xs: Column, used: list[Column], wanted=None) -> Column:
    """The first element that is not used, and wanted if asked."""
    free = lambda x: reduce(lambda a, u: a & ~x["slug"].eqNullSafe(u["slug"]), used, F.lit(True))
    return F.get(F.filter(xs, lambda x: free(x) & wanted(x) if wanted else free(x)), F.lit(0))


def decision_guide(matches: DataFrame) -> DataFrame:
    """rider_id, choice, slug from recommended matches.

    ``matches`` has rider_id, place, slug, score, role, size_cm, waist_width_mm, width_type, rider_width and
    riding_style. A choice without a fitting board left takes the best unused one, and without any the best.
    """
    m = F.struct("place", "slug", "score", "role", "size_cm", "waist_width_mm", "width_type", "rider_width", "riding_style")
    g = matches.groupBy("rider_id").agg(F.array_sort(F.collect_list(m)).alias("ms"))  # four at most
    ordered = lambda key: F.transform(F.array_sort(F.transform("ms", lambda x: F.struct(key(x).alias("o"), x.alias("x")))), lambda y: y["x"])
    rules = [
        (lambda x: -x["score"].cast("double"), lambda x: x["role"].isin("best-overall", "stable")),
        (lambda x: -x["waist_width_mm"].cast("double"), lambda x: (x["role"] == "width-safe") | (x["width_type"] == x["rider_width"])),
        (lambda x: x["size_cm"].cast("double"), lambda x: (x["role"] == "playful") | (x["riding_style"] == "park")),
    ]
    used: list[Column] = []
    for i, (key, wanted) in enumerate(rules):
        g = g.withColumn(f"p{i}", F.coalesce(_first(ordered(key), used, wanted), _first(F.col("ms"), used), F.col("ms")[0]))
        used = [*used, F.col(f"p{i}")]
    return g.select("rider_id", F.explode(F.array(*[F.struct(F.lit(n).alias("choice"), F.col(f"p{i}.slug").alias("slug")) for i, n in enumerate(PICKS)])).alias("c")).select("rider_id", "c.*")
