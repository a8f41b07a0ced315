"""Spec workbooks as tables: zipped sheets read cell by cell, then put together by Spark.

A workbook is opened where it lies and its XML read as a stream, so a task holds one element and one batch of cells.
Shared texts are a table of their own and are joined to the cells that name them.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.functions import text as tx
from firnline.operators.checks import width_of

SHEET, STRINGS = "xl/worksheets/sheet1.xml", "xl/sharedStrings.xml"
CELL = "path string, part string, row int, place string, kind string, value string"
BATCH = 4096


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _cells(source, part: str) -> Iterator[tuple[int, str, str, str]]:
    """row, column, type and raw value of each cell of a sheet; rows count as they stand, whatever they are called."""
    row, stack = -1, []
    for event, e in ElementTree.iterparse(source, ("start", "end")):
        name = _local(e.tag)
        if event == "start":
            stack.append(e)
            row += name == "row"
            continue
        stack.pop()
        if name == "c":
            value = next((v.text or "" for v in e if _local(v.tag) == "v"), "")
            column = re.match("[A-Z]+", e.get("r", ""))
            if column:
                yield row, column[0], e.get("t", ""), value
        if name in ("row", "c") and stack:
            stack[-1].remove(e)


def _strings(source) -> Iterator[tuple[int, str, str, str]]:
    """Number and text of each shared string; a string in several runs is one text."""
    at, stack = 0, []
    for event, e in ElementTree.iterparse(source, ("start", "end")):
        if event == "start":
            stack.append(e)
            continue
        stack.pop()
        if _local(e.tag) == "si":
            yield at, "", "s", "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")
            at += 1
            if stack:
                stack[-1].remove(e)


def workbook_cells(spark: SparkSession, folder: str, glob: str = "*.xlsx") -> DataFrame:
    """path, part (cell, string or broken), row, place, kind and value of all workbooks of a folder.

    Only names and sizes are read through Spark; tasks open the files themselves. A file that is no workbook, or breaks
    off, gives a row of part broken, and what was read before.
    """
    schema = pa.schema([(n.split()[0], pa.int32() if n.endswith("int") else pa.string()) for n in CELL.split(", ")])

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))
                held: list[tuple] = []
                try:
                    with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as book:
                        for part, member, read in (("string", STRINGS, _strings), ("cell", SHEET, None)):
                            if member not in book.namelist():
                                continue
                            with book.open(member) as source:
                                for row, place, kind, value in read(source) if read else _cells(source, part):
                                    held.append((uri, part, row, place, kind, value))
                                    if len(held) == BATCH:
                                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                                        held = []
                except (zipfile.BadZipFile, ElementTree.ParseError, EOFError, OSError, ValueError):
                    held.append((uri, "broken", 0, "", "", ""))
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    return files.mapInArrow(run, CELL)


def workbook_rows(cells: DataFrame, columns: list[str]) -> DataFrame:
    """path, row and the wanted columns as texts ('' where a cell is missing), with shared texts put in."""
    texts = cells.where("part = 'string'").select(F.col("path").alias("_p"), F.col("row").alias("_n"), F.col("value").alias("_text"))
    own = cells.where("part = 'cell'").withColumn("n", F.when((F.col("kind") == "s") & (F.col("value") != ""), F.col("value").try_cast("int")))
    j = own.join(texts, (F.col("path") == F.col("_p")) & (F.col("n") == F.col("_n")), "left")
    value = F.when(F.col("n").isNotNull(), F.coalesce("_text", F.lit(""))).otherwise(F.col("value"))
    return j.groupBy("path", "row").agg(*[F.coalesce(F.max(F.when(F.col("place") == c, value)), F.lit("")).alias(c) for c in columns])


def spec_groups(rows: DataFrame) -> DataFrame:
    """book, key, model_name, shape, purpose, flex and sizes of each model of a sheet (book, row, A, B, C, D, H, K).

    The first row is the head. A row with a name and a shape, a purpose or a flex begins a model, and the rows below
    belong to it; sizes stand in D, or in A where D is empty, and count with a plausible waist in H. Of models of one
    key the last stands. A sheet is ordered within its book, so books are the unit of parallel work.
    """
    t = {c: tx.space(F.col(c)) for c in "ABCDHK"}
    first = F.min("row").over(Window.partitionBy("book"))
    r = rows.withColumn("_first", first).where("row > _first").select("book", "row", *[v.alias(c) for c, v in t.items()])
    head = (F.col("A") != "") & ((F.col("B") != "") | (F.col("C") != "") | (F.col("K") != ""))
    down = Window.partitionBy("book").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("g", F.sum(F.when(head, 1).otherwise(0)).over(down)).where("g > 0")
    label = F.when(F.col("D") != "", F.col("D")).otherwise(F.col("A"))
    model = F.first("A").over(Window.partitionBy("book", "g").orderBy("row"))
    s = r.withColumn("model", model).withColumns({"label": label, "cm": tx.size_cm(label), "mm": tx.waist_mm(F.col("H"))})
    counts = (F.col("label") != "") & ~((F.col("label") == F.col("model")) & (F.col("D") == "")) & tx.plausible_waist(F.col("cm"), F.col("mm"))
    size = F.struct("row", F.col("cm").alias("size_cm"), F.col("label").alias("size_label"), F.col("mm").alias("waist_width_mm"), width_of(F.col("mm")).alias("width_type"))
    at_head = lambda c: F.max(F.when(head, F.col(c)))
    g = s.groupBy("book", "g").agg(at_head("A").alias("model_name"), at_head("B").alias("shape"), at_head("C").alias("purpose"), at_head("K").alias("K"), F.array_sort(F.collect_list(F.when(counts, size))).alias("sizes"))
    g = g.withColumn("key", tx.board_key(F.col("model_name")))
    last = g.groupBy("book", "key").agg(F.max("g").alias("g"))
    return g.join(last, ["book", "key", "g"]).select("book", "key", "model_name", "shape", "purpose", tx.flex_number(F.col("K")).alias("flex"), "sizes")


def book_of(path: Column) -> Column:
    """The address under which a landed workbook was fetched: its name without folder and ending."""
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.xlsx$", "")
