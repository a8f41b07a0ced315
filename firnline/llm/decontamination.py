"""Marking document words that lie in passages of a benchmark, by winnowed k-gram fingerprints.

Every benchmark window of ``span`` words is known by the least of its ``span - k + 1`` k-gram hashes. A document
keeps the least k-gram hash of each of its own windows; as the rule looks at the window's words alone, a window
that stands in both selects the same hash in both, so joining selected hashes misses none. Each hit is extended:
the document window that chose the hash is held against the benchmark's word by word. DataFrame functions only.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.llm.copies import numbered_copies

#: What separates words: ASCII other than digits and lower-case letters, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of the benchmark that are broadcast at most, and their bytes with the ids of their items; beyond, both sides are
#: shuffled.
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 64 << 20


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none of a null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), lambda w: w != "")


def content_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.octet_length(text))


def _gram(hashes: Column, x: Column, i: Column, k: int) -> Column:
    return F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)])


def _grams(hashes: Column, k: int) -> Column:
    """Hashes of the k-grams at each word; the last k - 1 are null."""
    return F.transform(hashes, lambda x, i: F.when(i + k <= F.size(hashes), _gram(hashes, x, i, k)))


def _least(grams: Column, x: Column, i: Column, width: int) -> Column:
    return F.least(x, *[F.get(grams, i + j) for j in range(1, width)]) if width > 1 else x


def benchmark_windows(items: DataFrame, span: int, k: int) -> DataFrame:
    """window (array of words), n, fingerprint, items (distinct item ids as strings), shift of the k-gram in the window."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (span - 1), F.lit(1)))
    windows = words.select("item", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, span))).alias("window"))
    whole = windows.groupBy("window").agg(F.collect_set("item").alias("items")).withColumn("n", F.size("window"))
    hashed = whole.withColumn("h", F.transform("window", lambda x: F.xxhash64(x)))
    all_of = lambda n: F.xxhash64(*[F.get("h", F.lit(j)) for j in range(n)])
    # a window of fewer words than `span` is one gram of its own length
    short = reduce(lambda out, n: F.when(F.col("n") == n, all_of(n)).otherwise(out), range(1, span), F.lit(None).cast("long"))
    least = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(span - k)), lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(k)])))
    return hashed.withColumn("fingerprint", F.when(F.col("n") < span, short).otherwise(least)).drop("h")


def mark_contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, keyed: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored. A null or wordless
    text has no words and no hits; a null item id is the item ``''``; equal windows of several items count for
    each; equal documents get equal rows. With an empty benchmark nothing is hit. ``keyed`` adds the column content,
    which with doc_id tells rows of different texts apart.
    """
    windows = benchmark_windows(benchmark, span, k)
    room = F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", ","))
    totals = windows.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.sum(room).alias("room")).collect()  # at most `span` rows
    lengths = {r["n"]: r["c"] for r in totals}
    small = sum(lengths.values()) <= BROADCAST_WINDOWS and sum(r["room"] for r in totals) <= BROADCAST_BYTES
    width = span - k + 1
    base = docs.select("doc_id", content_key(F.col("text")).alias("content"), words_of(F.col("text")).alias("words"))
    hashed = base.withColumn("h", F.transform("words", lambda x: F.xxhash64(x))).withColumn("gram", _grams(F.col("h"), k))
    selected = F.transform(F.slice(F.col("gram"), 1, F.greatest(F.size("gram") - (span - 1), F.lit(0))), lambda x, i: _least(F.col("gram"), x, i, width))
    lesser = [n for n in sorted(lengths) if n < span]
    firsts = lambda n: F.greatest(F.size("words") - (n - 1), F.lit(0))
    short = [F.slice(_grams(F.col("h"), n), 1, firsts(n)) for n in lesser]
    # one hash per window of the document, by length and start, and a null that stands for the document itself
    rows = hashed.select("doc_id", "content", "words", F.array_append(F.concat(selected, *short), F.lit(None).cast("long")).alias("selected"))
    offset, before = F.lit(0), firsts(span)
    for n in lesser:
        offset, before = F.when(F.col("_n") == n, before).otherwise(offset), before + firsts(n)
    grouped = windows.groupBy("fingerprint").agg(F.collect_list(F.struct("window", "n", "items")).alias("found"))
    spread = lambda *columns: rows.select(*columns, F.posexplode_outer("selected").alias("place", "fingerprint"))
    if small:
        probes = spread("doc_id", "content", "words")
        joined = probes.join(F.broadcast(grouped), "fingerprint", "left").where(F.col("fingerprint").isNull() | F.col("found").isNotNull())
    else:  # narrow rows find the hits; words travel for those alone
        hits = spread("doc_id", "content").distinct().join(grouped, "fingerprint").select(F.col("doc_id").alias("_d"), F.col("content").alias("_c"), "place", "fingerprint", "found")
        own = rows.select("doc_id", "content", "words", F.lit(0).alias("place"), F.lit(None).cast("long").alias("fingerprint"), F.lit(None).cast(grouped.schema["found"].dataType).alias("found"))
        met = rows.select("doc_id", "content", "words").join(hits, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("content") == F.col("_c"))).select("doc_id", "content", "words", "place", "fingerprint", "found")
        joined = own.unionByName(met)
    # the k-gram's window is held against each benchmark window with that fingerprint, word by word
    one = joined.select("doc_id", "content", "words", "place", "fingerprint", F.explode_outer("found").alias("f")).select("*", F.col("f.n").alias("_n"))
    start = F.col("place") - offset
    same = F.when(F.col("f").isNotNull() & (start >= 0), F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("_n")) == F.col("f.window"))
    marked = one.where(F.col("fingerprint").isNull() | same).select(
        "doc_id",
        "content",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.col("fingerprint").isNull(), 1).otherwise(0).alias("own"),
        F.when(F.col("fingerprint").isNotNull(), F.struct(start.alias("at"), F.col("_n").alias("n"))).alias("hit"),
        F.when(F.col("fingerprint").isNotNull(), F.col("f.items")).alias("items"),
    )
    # a document's own hits: no longer than the document
    per_doc = marked.groupBy("doc_id", "content", "n_words").agg(F.sum("own").alias("copies"), F.array_distinct(F.flatten(F.transform(F.collect_set("hit"), lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    named = per_doc.select(
        "doc_id",
        *(["content"] if keyed else []),
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
        "copies",
    )
    return numbered_copies(named, "copies", "_copy").drop("copies", "_copy")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark passage occurs, columns as they were.

    Rows with a null doc_id or text, and repeated rows, stay or go by their own text; an empty benchmark takes nothing,
    and an empty table stays empty. Columns of any name pass through.
    """
    bad = mark_contamination(docs, benchmark, keyed=True).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("content").alias("_c")).distinct()
    keyed = docs.select("doc_id", content_key(F.col("text")).alias("_content"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_content") == F.col("_c")), "left_anti").select("_row.*")
