"""Riders meet the best sizes of equal measures only, and get what a comparison with all sizes gives."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from firnline.operators import recommend as rec
from firnline.plans import bindings as b

SF = "/root/testdata/sf0.001"


def test_shortlist_is_the_head_of_all_candidates(spark):
    riders = b.riders(spark, SF)
    products = b.products(spark, SF).withColumn("family_id", F.when(F.rand(3) < 0.5, F.concat(F.lit("f-"), F.floor(F.rand(4) * 9).cast("string"))))
    products = spark.createDataFrame(products.collect(), products.schema)  # large families
    sizes = b.sizes(spark, SF).unionByName(b.sizes(spark, SF).withColumn("waist_width_mm", F.lit(None).cast("int")))
    keys = ["height_cm", "weight_kg", "boot_size_eu", "board_line_preference", "skill_level", "rider_style", "terrain_priority", "aggressiveness", "stance_type"]
    family = F.coalesce(F.concat(F.lit("f:"), "family_id"), F.concat(F.lit("p:"), "product_id"))
    all_of_them = rec.candidates(riders, products, sizes)
    best = all_of_them.groupBy(*keys, family.alias("f")).agg(F.min(F.struct((-F.col("score")).alias("o"), "slug", "size_cm", "size_label", "waist_width_mm")).alias("m"))
    want = best.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("m"))).where("n <= 7 and m.o <= -40").select(*keys, "m.*")
    short = rec.shortlist(riders, products, sizes)
    got = short.select(*keys, (-F.col("score")).alias("o"), "slug", "size_cm", "size_label", "waist_width_mm")
    want, got = sorted(map(str, want.collect())), sorted(map(str, got.collect()))
    assert got == want and len(got) > 100 and all_of_them.count() > 4 * len(got)
