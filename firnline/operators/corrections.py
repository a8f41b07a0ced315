"""Corrections of what a source says, by its number, carried out only while the product is still the one that was meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.text import board_key
from firnline.operators.checks import width_of


def corrected(products: DataFrame, corrections: DataFrame, years: bool = True) -> DataFrame:
    """Products (source_product_id, brand, model_name, board_line, line_evidence) with correction (none, applied, agrees or conflict).

    ``corrections`` has source_product_id (unique), expected_brand, expected_model (null: any) and corrected_line. A
    product of another brand or model, or with evidence of another line, is in conflict and stays as it is; one without
    evidence gets the line, which then is known; one that says the same already agrees. ``years`` is that of ``board_key``.
    """
    c = corrections.select(F.col("source_product_id").cast("string").alias("_id"), "expected_brand", "expected_model", "corrected_line")
    j = products.join(c, F.col("source_product_id").cast("string") == F.col("_id"), "left")
    same = lambda own, wanted: F.col(wanted).isNull() | F.coalesce(board_key(F.col(own), years) == board_key(F.col(wanted), years), F.lit(False))
    meant = same("brand", "expected_brand") & same("model_name", "expected_model")
    known, has = F.col("line_evidence") == "known", F.col("corrected_line").isNotNull()
    state = (
        F.when(F.col("_id").isNull(), "none").when(~meant, "conflict").when(~has, "agrees").when(known & (F.col("board_line") != F.col("corrected_line")), "conflict").when(known, "agrees").otherwise("applied")
    )
    good = has & state.isin("applied", "agrees")
    return j.withColumn("correction", state).withColumns({"board_line": F.when(good, F.col("corrected_line")).otherwise(F.col("board_line")), "line_evidence": F.when(good, "known").otherwise(F.col("line_evidence"))}).drop("_id", "expected_brand", "expected_model", "corrected_line")


def correction_report(corrections: DataFrame, products: DataFrame) -> DataFrame:
    """source_product_id and outcome of every correction: unused where no product has its number, else how often each state came up."""
    met = products.where("correction <> 'none'").groupBy(F.col("source_product_id").cast("string").alias("_id"), "correction").agg(F.count(F.lit(1)).alias("n"))
    j = corrections.select(F.col("source_product_id").cast("string").alias("source_product_id")).distinct().join(met, F.col("source_product_id") == F.col("_id"), "left")
    return j.select("source_product_id", F.coalesce("correction", F.lit("unused")).alias("outcome"), F.coalesce("n", F.lit(0)).alias("n"))


def corrected_widths(sizes: Column, widths: Column) -> Column:
    """An array of sizes (size_cm, waist_width_mm, width_type and others) with the waists of a map by whole length put in."""
    def one(s: Column) -> Column:
        waist = F.coalesce(F.try_element_at(widths, s["size_cm"].cast("int")), s["waist_width_mm"])
        whole = s["size_cm"] == F.floor(s["size_cm"])
        waist = F.when(whole, waist).otherwise(s["waist_width_mm"])
        return s.withField("waist_width_mm", waist.cast("int")).withField("width_type", width_of(waist))

    return F.when(widths.isNull(), sizes).otherwise(F.transform(sizes, one))
