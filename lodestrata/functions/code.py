"""Chunks of source code that follow its structure.

No grammar is needed: Python is cut at the statements its own parser finds, the
brace languages at lines that close what the outermost level opened. Units are
merged greedily up to the budget, and units over it are cut again one level
further in. Every chunk is a slice of the source, and the slices cover all of it.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.markdown import lines

_SYMBOL = re.compile(r"^\s*(?:export\s+|default\s+|pub(?:\([^)]*\))?\s+|async\s+|public\s+|private\s+|static\s+)*(def|class|func|fn|function|interface|type|struct|enum|impl|trait|mod|const|let)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)")


def _tokens(s: str) -> int:
    return max(1, len(s) // 4) if s else 0


def _python_starts(source: str, first: int) -> list[int] | None:
    """Lines, from 0, where the statements of the outermost level begin, decorators included."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return sorted({min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1 + first for node in tree.body})


def _brace_starts(rows: list[str], first: int) -> list[int]:
    depth, starts, new = 0, [], True
    for k, row in enumerate(rows):
        if depth <= 0 and new and row.strip():
            starts.append(first + k)
        plain = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*$", "", row)
        depth += sum(plain.count(c) for c in "{([") - sum(plain.count(c) for c in "})]")
        new = depth <= 0
    return starts


def _indent_starts(rows: list[str], first: int) -> list[int]:
    """Lines of the least indentation, for what neither parser nor braces can cut."""
    deep = [len(r) - len(r.lstrip()) for r in rows if r.strip()]
    least = min(deep, default=0)
    return [first + k for k, r in enumerate(rows) if r.strip() and len(r) - len(r.lstrip()) == least]


def chunk_source(source: str, lang: str, most: int, most_chunks: int | None = None) -> list[tuple[int, int, str]]:
    """(first line, last line, label) from 1 of the chunks of a source; their lines cover it without overlap. With most_chunks, a source is cut by lines only once it has so many; without, by its structure to its end."""
    rows = source.splitlines(keepends=True)
    out: list[tuple[int, int]] = []
    # Spans still to cut, last first, with whether a cut further in may help.
    stack = [(0, len(rows), True)]
    while stack:
        a, b, structured = stack.pop()
        if a >= b:
            continue
        if _tokens("".join(rows[a:b])) <= most or b - a == 1:
            out.append((a, b))
            continue
        part = rows[a:b]
        starts = None
        if structured and (most_chunks is None or len(out) < most_chunks):
            if a == 0 and b == len(rows):
                starts = _python_starts("".join(part), a) if lang == "python" else None
            if starts is None:
                starts = _brace_starts(part, a) if lang != "python" else _indent_starts(part, a)
            if len(starts) < 2 and b - a > 2:
                starts = [a, *_indent_starts(part[1:], a + 1)]
        if not starts or len({a, *starts}) < 2:
            stack.extend((k, k + 1, False) for k in range(b - 1, a - 1, -1))
            continue
        cuts = sorted({a, *starts, b})
        stack.extend((x, y, (x, y) != (a, b)) for x, y in reversed(list(zip(cuts[:-1], cuts[1:], strict=True))))
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if merged and _tokens("".join(rows[merged[-1][0] : b])) <= most:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    named = []
    for a, b in merged:
        names = [m[2] for r in rows[a:b] if (m := _SYMBOL.match(r))]
        named.append((a + 1, b, ", ".join(names[:3]) if names else f"L{a + 1}:1"))
    return named


def fenced_code(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(doc_id, block_no, lang, source) of the fenced blocks of documents; lang is '' where the fence names none."""
    from pyspark.sql import Window

    upto = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(docs, id_col, text_col).where("fenced").withColumn("mark", F.sum(F.col("fence").cast("int")).over(upto))
    rows = rows.withColumn("block_no", F.floor((F.col("mark") - 1) / 2))
    opening = F.regexp_extract(F.min(F.when(F.col("fence"), F.struct("n", "line")))["line"], r"^\s*`{3,}\s*([A-Za-z0-9+#-]*)", 1)
    parts = rows.groupBy("doc_id", "block_no").agg(F.lower(opening).alias("lang"), F.array_sort(F.collect_list(F.when(~F.col("fence"), F.struct("n", "line")))).alias("body"))
    return parts.select("doc_id", "block_no", "lang", F.array_join(F.transform("body", lambda x: x["line"]), "\n").alias("source")).where("source <> ''")


def chunk_code(sources: DataFrame, most: int = 450, most_chunks: int | None = None) -> DataFrame:
    """(doc_id, block_no, chunk_no, first_line, last_line, label, content) of sources(doc_id, block_no, lang, source); no grammar gives the same cut as any other text by indentation. Null sources give no rows."""
    kinds = [("doc_id", pa.int64()), ("block_no", pa.int64()), ("chunk_no", pa.int32()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("label", pa.string()), ("content", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["source"]:
                    text = r["source"].splitlines(keepends=True)
                    rows += [(r["doc_id"], r["block_no"], k, a, b, label, "".join(text[a - 1 : b])) for k, (a, b, label) in enumerate(chunk_source(r["source"], r["lang"], most, most_chunks))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds)], schema=pa.schema(kinds))

    return sources.select("doc_id", "block_no", "lang", "source").mapInArrow(run, "doc_id long, block_no long, chunk_no int, first_line int, last_line int, label string, content string")
