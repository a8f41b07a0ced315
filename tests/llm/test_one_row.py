"""One row of each near-duplicate component stays, whatever the doc_ids."""

import random
from collections import Counter

import pytest
from firnline.llm import similar, simhash


@pytest.mark.parametrize("keep", [simhash.keep_one_of_each, similar.keep_one_of_each])
def test_one_row_per_component_whatever_the_ids(spark, keep):
    rng = random.Random(6)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (7, text[2]), (7, text[3]), (3, text[3]), (7, text[4]), (9, text[4]), (None, text[5]), (8, text[5])]
    kept = keep(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, text[0]), (None, text[1]), (7, text[2]), (3, text[3]), (7, text[4]), (8, text[5])])
