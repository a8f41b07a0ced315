"""Mixing sources to temperature weights.

Source token shares p are raised to an exponent in [0, 1] and normalised. The exponent is bisected: the largest
that still meets a target entropy, or, if that would repeat a source too often, the smallest that keeps every
source within the repetition limit. The weights are then realised as token budgets. Each source is read in
passes; a pass is a permutation of its documents by hash blocks, and the pass in which the budget ends is cut
there. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.copies import numbered_copies

WORDS = r"[^\x20\x09-\x0D]+"
STEPS = 40
#: Hash blocks of a pass over one source.
BLOCKS = 1024
#: Sources that are broadcast at most; beyond, they are joined by shuffling.
BROADCAST_SOURCES = 100_000


def tokens_of(text: Column) -> Column:
    """Words plus one end mark, so that every document costs something."""
    return (F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)) + F.lit(1)).cast("long")


def _sum(xs: Column, f) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, p: acc + f(p))


def _entropy(shares: Column, a: Column) -> Column:
    z = _sum(shares, lambda p: F.pow(p, a))
    return F.log(z) - a * _sum(shares, lambda p: F.pow(p, a) * F.log(p)) / z


def _bisect(too_high) -> Column:
    """The exponent at which ``too_high`` turns true, to 2**-40."""

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / F.lit(2.0)
        high = too_high(mid)
        return F.struct(F.when(high, acc["lo"]).otherwise(mid).alias("lo"), F.when(high, mid).otherwise(acc["hi"]).alias("hi"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
    return (out["lo"] + out["hi"]) / F.lit(2.0)


def source_weights(totals: DataFrame, entropy: float, repetition: float, budget: int | None = None) -> DataFrame:
    """source, total, weight, quota, exponent from source and total (tokens), one row per source.

    ``entropy`` is a share of the largest possible one, ln(sources). ``budget`` is the tokens of the mixture; by
    default as many as let the least repeated source be read once whole.
    """
    one = totals.agg(F.array_sort(F.collect_list(F.struct("total", "source"))).alias("rows"))
    one = one.withColumn("all", F.aggregate("rows", F.lit(0).cast("long"), lambda acc, r: acc + r["total"])).where("all > 0").withColumn("ps", F.transform("rows", lambda r: r["total"] / F.col("all")))
    ratio = F.element_at("ps", -1) / F.element_at("ps", 1)
    least = F.lit(entropy) * F.log(F.size("ps"))
    by_entropy = F.when(_entropy(F.col("ps"), F.lit(1.0)) >= least, F.lit(1.0)).otherwise(_bisect(lambda a: _entropy(F.col("ps"), a) < least))
    by_repetition = F.when(ratio <= F.lit(repetition), F.lit(0.0)).otherwise(_bisect(lambda a: F.pow(ratio, F.lit(1.0) - a) <= F.lit(repetition)))
    one = one.withColumn("exponent", F.round(F.greatest(by_entropy, by_repetition), 6)).withColumn("z", _sum(F.col("ps"), lambda p: F.pow(p, F.col("exponent"))))
    whole = F.lit(float(budget)) if budget is not None else F.element_at("rows", -1)["total"] * F.col("z") / F.pow(F.element_at("ps", -1), F.col("exponent"))
    each = one.select("exponent", "all", "z", whole.alias("budget"), F.explode("rows").alias("r"))
    weight = F.pow(F.col("r.total") / F.col("all"), F.col("exponent")) / F.col("z")
    return each.select("r.source", "r.total", weight.alias("weight"), F.round(F.col("budget") * weight).cast("long").alias("quota"), "exponent")


def _draw(*parts: Column) -> Column:
    """60 bits of a hash that SQL engines share."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def mix_sources(units: DataFrame, entropy: float = 0.95, repetition: float = 2.0, budget: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """source, doc_id, content, tokens, copies, pass, start: each reading of a document in its source's stream.

    ``units`` has source, doc_id, content (a string that tells texts apart) and tokens. Rows equal in all four are
    one unit of their joint tokens, ``copies`` of them; a unit is read in pass k if its ``start`` in that pass lies
    before the rest of the budget. A null source is the source ``''``. An empty table gives no rows.
    """
    rows = units.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "doc_id", "content", "tokens").groupBy("source", "doc_id", "content", "tokens").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("cost", F.col("tokens") * F.col("copies"))
    totals = rows.groupBy("source").agg(F.sum("cost").alias("total"))
    weights = source_weights(totals, entropy, repetition, budget)
    few = totals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    passes = F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.col("quota"), F.lit(1)) - F.lit(1)) / F.col("total")).cast("long"))
    read = rows.join(F.broadcast(weights) if few else weights, "source").where("quota > 0").select("source", "doc_id", "content", "tokens", "copies", "cost", "total", "quota", F.explode(passes).alias("pass"))
    placed = read.withColumn("draw", _draw(F.col("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("content"), F.col("pass"))).withColumn("block", F.pmod("draw", F.lit(blocks)).cast("int"))
    before = Window.partitionBy("source", "pass").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy("source", "pass", "block").agg(F.sum("cost").alias("c")).select("source", "pass", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("head"))
    within = Window.partitionBy("source", "pass", "block").orderBy("draw", "doc_id", "content").rowsBetween(Window.unboundedPreceding, -1)
    started = placed.join(heads, ["source", "pass", "block"]).withColumn("start", F.col("head") + F.coalesce(F.sum("cost").over(within), F.lit(0)))
    return started.where(F.col("start") < F.col("quota") - F.col("pass") * F.col("total")).select("source", "doc_id", "content", "tokens", "copies", "pass", "start")


def units_of(docs: DataFrame) -> DataFrame:
    return docs.select("source", "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"), tokens_of(F.col("text")).alias("tokens"))


def mixture(docs: DataFrame, **limits) -> DataFrame:
    """source, doc_id, n_tokens, pass, start: the mixed stream over all documents, by source, pass and token offset."""
    mixed = mix_sources(units_of(docs), **limits)
    return numbered_copies(mixed, "copies", "j").select("source", "doc_id", F.col("tokens").alias("n_tokens"), "pass", (F.col("start") + F.col("j") * F.col("tokens")).alias("start"))


def mix_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture reads it, with the columns of ``docs``.

    A null source is the source ``''``, a null or empty text costs one token, rows equal in doc_id, source and text are
    read equally often, and an empty table stays empty. Columns of any name pass through.
    """
    keyed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_content"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    times = mix_sources(units_of(docs), **limits).groupBy(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("content").alias("_c")).agg(F.count(F.lit(1)).alias("_times"))
    on = (F.col("doc_id").eqNullSafe(F.col("_d"))) & (F.col("_content") == F.col("_c")) & (F.col("_source") == F.col("_s"))
    read = keyed.join(times, on).select("_row", "_times")
    return numbered_copies(read, "_times", "_again").select("_row.*")
