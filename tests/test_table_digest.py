"""The digest of a whole table against hashlib; any changed cell shows."""

import hashlib
import json
from collections import defaultdict

from firnline.operators import digest
from firnline.plans.registry import queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_digest_covers_every_column(spark):
    supplier = spark.read.parquet(f"{SF}/supplier.parquet")
    parts = defaultdict(list)
    for r in supplier.collect():
        k = str(r.s_suppkey)
        parts[md5(k)[:3]].append((k, md5(json.dumps(r.asDict(), sort_keys=True, separators=(",", ":")))))
    want = md5("".join(md5("".join(h for _, h in sorted(parts[p]))) for p in sorted(parts)))
    got = queries()["table_digest"](spark, SF).collect()
    assert [(r.rows, r.md5) for r in got] == [(supplier.count(), want)]
    for c in supplier.columns[1:]:
        value = F.lit("x") if c == "s_name" else F.col(c) + 1
        assert digest.checksum(supplier.withColumn(c, F.when(F.col("s_suppkey") == 3, value).otherwise(F.col(c))), "s_suppkey").first().md5 != want
