"""With a least run, single short repeated units stay and runs of them go."""

from firnline.llm import linededup

LONG = "This passage has several sentences. They stand in more than one document! So the later copies of it go. What is said between them stays where it is, of course."
ROWS = [
    (1, f"Home\nYes.\nown one\n{LONG}\nend one"),
    (2, f"Yes.\nHome\nown two {LONG} end two. Yes."),
    (3, "Home\n\n \nYes.\n"),
    (4, None),
    (5, ""),
    (6, "Home\nLogin\nown six"),
    (7, "Home\nLogin\n\nHome\nown seven"),
    (8, f"{LONG[:80]}\nown eight\n"),
]


def test_runs(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in linededup.line_report(docs, 100).collect()}
    texts = dict(ROWS)
    first = LONG.index("They")
    assert got[1].text == texts[1] and got[1].n_found == 0
    assert got[2].text == f"Yes.\nHome\nown two {LONG[:first]}end two. Yes." and got[2].n_found > len(LONG) - first
    assert got[3].text == "\n \n" or got[3].text.strip() == ""
    assert got[4].text == got[5].text == "" and got[4].n_spans == 0
    assert got[6].text == texts[6] and got[7].text == texts[7] and got[7].n_found > 0
    assert all(r.n_removed == sum(x.b - x.a for x in r.removed) == r.n_bytes - len(r.text.encode()) for r in got.values())


def test_runs_from_a_long_text(spark):
    body = "\n".join(f"line number {i} of a long document" for i in range(40_000))
    assert len(body) > 1 << 20
    got = {r.doc_id: r for r in linededup.line_report(spark.createDataFrame([(1, body), (2, f"own\n{body}")], "doc_id long, text string"), 128).collect()}
    assert got[1].n_removed == 0 and got[2].text == "own\n" and got[2].n_spans == 1
