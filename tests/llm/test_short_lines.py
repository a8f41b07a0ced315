"""Short lines, lines in scripts without spaces and short sentences go when they are repeated."""

from firnline.llm import linededup

ROWS = [
    (1, "All rights reserved\nHome\nfirst own line\n---\n\n"),
    (2, "second own line\nhome\n  \nall rights reserved.\n---\n***\n"),
    (3, "这是一行没有空格的文字\nown 3. It is so. Yes it is! Own three\n***"),
    (4, "这是一行没有空格的文字\n! ! \nown 4. It is so. Yes it is! Own four\n\n  \n"),
    (5, "Home"),
    (6, "ยินดีต้อนรับ\n- -\n"),
    (7, "ยินดีต้อนรับ\n- -\n--\n"),
]
KEPT = {
    1: "All rights reserved\nHome\nfirst own line\n---\n\n",
    2: "second own line\n  \n***\n",
    3: "这是一行没有空格的文字\nown 3. It is so. Yes it is! Own three\n",
    4: "! ! \nown 4. Own four\n\n  \n",
    5: "",
    6: "ยินดีต้อนรับ\n- -\n",
    7: "--\n",
}


def test_repeated_units_go_whatever_their_length(spark):
    got = linededup.line_report(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.text for r in got} == KEPT
