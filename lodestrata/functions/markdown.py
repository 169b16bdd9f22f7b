"""Structure of markdown documents.

Sections are read in one pass over each partition, without a shuffle. What asks
for single lines, headings or edits is a relational plan over lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import body, packed, slug, strip, unix_lines
from lodestrata.session import spread

_HEADING = r"^(#{1,6})\s+(\S.*?)(?:\s+#+)?\s*$"


def lines(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(doc_id, n, line, fence, fenced, level, title): the lines after the front matter.

    fence marks lines that open or close a fence, fenced those within one; level
    is 0 but for headings outside fences. Documents with a null text have none.
    """
    doc = Window.partitionBy("doc_id").orderBy("n")
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(body(unix_lines(F.col(text_col))), "\n")).alias("n", "line"))
    out = out.withColumn("fence", F.col("line").rlike(r"^\s*```"))
    before = F.coalesce(F.sum(F.col("fence").cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("fenced", F.col("fence") | (F.pmod(before, F.lit(2)) == 1))
    heading = F.when(~F.col("fenced") & F.col("line").rlike(_HEADING), F.col("line"))
    level = F.char_length(F.regexp_extract(heading, r"^(#+)", 1))
    return out.withColumn("level", F.coalesce(level, F.lit(0))).withColumn("title", F.when(F.col("level") > 0, F.regexp_extract("line", _HEADING, 2)))


def table_of_contents(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(doc_id, n, level, title, anchor): headings with anchors unique in the document, the level one deeper as in a page; later equal slugs get -2, -3 and so on."""
    found = lines(docs, id_col, text_col).where("level > 0").withColumn("slug", F.coalesce(slug(F.col("title")), F.lit("section")))
    place = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("n"))
    return found.select("doc_id", "n", F.least(F.col("level") + 1, F.lit(6)).alias("level"), "title", F.when(place == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), place.cast("string"))).alias("anchor"))


#: What can start a line and matter: a fence, or one to six # with a text.
_MARK = re.compile(r"^(?:[^\S\n]*(?P<fence>```)|(?P<level>#{1,6})[^\S\n]+(?P<title>\S[^\n]*))", re.MULTILINE)
_RULE = re.compile(r"^---$", re.MULTILINE)


def headings(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, level, title) of the heading lines of a text with Unix lines, outside fences; hashes at a title's end are no part of it."""
    inside = False
    for mark in _MARK.finditer(text):
        if mark["fence"]:
            inside = not inside
        elif not inside and (title := mark["title"].rstrip().rstrip("#").rstrip()):
            yield mark.start(), mark.end(), len(mark["level"]), title


def parse(content: str) -> list[tuple[str, str]]:
    """(heading_path, text) of the sections of a document that are not empty.

    Front matter (a first line --- through the next line ---) is dropped. A
    heading is a line of one to six # at its very start, white space and a text,
    outside fences; hashes at its end are no part of the text. A fence opens and
    closes at lines that begin, after white space, with three backticks; one
    never closed reaches to the end. The path holds the texts of the open
    headings, outermost first.

    The headings' spans are found in one pass, and a section is the slice
    between two of them; an open heading stands in the slot of its level.
    """
    text = content.replace("\r\n", "\n")
    begin = rule.end() if text.startswith("---\n") and (rule := _RULE.search(text, 4)) else 0
    text = text[begin:]
    slots, out, at = [""] * 7, [], 0
    for start, end, level, title in (*headings(text), (len(text), len(text), 0, "")):
        if body_ := text[at:start].strip():
            out.append((" > ".join(filter(None, slots)), body_))
        slots[level:] = [title] + [""] * (6 - level)
        at = end
    return out


def sections(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(doc_id, section_no, heading_path, text): the text between two headings, stripped, as parse() gives it; null ids and texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, k, path, text) for i, c in zip(batch["id"].to_pylist(), batch["text"], strict=True) for k, (path, text) in enumerate(parse(c.as_py()))]
            columns = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()))], ["doc_id", "section_no", "heading_path", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return spread(rows).mapInArrow(run, "doc_id long, section_no int, heading_path string, text string")


def chunks(docs: DataFrame, id_col: str = "id", text_col: str = "content", most: int = 450) -> DataFrame:
    """(doc_id, chunk_index, heading_path, content): sections, those over the budget packed by paragraphs."""
    cut = sections(docs, id_col, text_col).select("doc_id", "section_no", "heading_path", F.posexplode(packed(F.col("text"), most)).alias("piece", "content"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no", "piece")) - 1
    return cut.select("doc_id", place.alias("chunk_index"), "heading_path", "content")


def _section_span(docs: DataFrame, heading: str, id_col: str, text_col: str) -> DataFrame:
    """The lines of documents with a heading of that name, with whether they are of its section: to the next heading of its level or less."""
    rows = lines(docs, id_col, text_col)
    doc = Window.partitionBy("doc_id")
    hit = (F.col("level") > 0) & (F.lower("title") == heading.strip().lstrip("#").strip().lower())
    rows = rows.withColumn("start", F.min(F.when(hit, F.struct("n", "level"))).over(doc)).where("start is not null")
    end = F.min(F.when((F.col("n") > F.col("start.n")) & F.col("level").between(1, F.col("start.level")), F.col("n"))).over(doc)
    return rows.withColumn("end", end).withColumn("own", (F.col("n") >= F.col("start.n")) & (F.col("end").isNull() | (F.col("n") < F.col("end"))))


def extract_section(docs: DataFrame, heading: str, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(doc_id, section): the section under the first heading of that name, heading included; documents without it have no row."""
    own = _section_span(docs, heading, id_col, text_col).where("own")
    joined = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("body"))
    return joined.select("doc_id", strip(F.array_join(F.transform("body", lambda x: x["line"]), "\n")).alias("section"))


def replace_section(docs: DataFrame, heading: str, text: str, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(doc_id, content): the document with that section replaced; documents without it have no row, so nothing is ever overwritten whole."""
    rows = _section_span(docs, heading, id_col, text_col).where("not own or n = start.n")
    rows = rows.withColumn("line", F.when(F.col("own"), F.lit(text.strip("\n"))).otherwise(F.col("line")))
    joined = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("body"))
    return joined.select("doc_id", F.concat(strip(F.array_join(F.transform("body", lambda x: x["line"]), "\n")), F.lit("\n")).alias("content"))
