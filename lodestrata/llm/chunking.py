"""Pieces of bounded size, cut at natural boundaries.

A text is cut into sections at its headings; a section over the limit is cut
recursively down a hierarchy of separators (paragraph, line, sentence, word,
character), and the parts of a level are packed greedily. Pieces are slices of
their section, and neighbours share a stated overlap, so a section can be put
together again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.markdown import parse
from lodestrata.session import spread

#: Characters a token stands for.
CHARS = 4
#: The places where a text may be cut, best first: paragraphs, lines, sentences, words; a cut is after the match.
_SEPARATORS = tuple(re.compile(p) for p in (r"\n[^\S\n]*\n\s*", r"\n+", r"[.!?…]+[\"')\]»”’]*\s+|[。！？]+[」』”’]*\s*", r"\s+"))
#: Characters that an overlap may be longer by, to begin with a word.
BACK = 24


def count_tokens(text: str) -> int:
    return max(1, len(text) // CHARS) if text else 0


def _ends(text: str, start: int, end: int, room: int, level: int = 0) -> list[int]:
    """The ends of the parts of text[start:end], each of room characters at most.

    What is too long is split at the separators of a level, and the splits are
    packed greedily; a split that is too long by itself is cut at the next level
    down, after what was packed before it. So a part never begins in one
    paragraph and ends within another; only a run without any separator is cut
    between characters.
    """
    if end - start <= room:
        return [end]
    if level == len(_SEPARATORS):
        return [*range(start + room, end, room), end]
    out, last = [], start
    for split in (*(m.end() for m in _SEPARATORS[level].finditer(text, start, end)), end):
        if split - start > room:
            if last > start:
                out.append(last)
                start = last
            if split - start > room:
                out += _ends(text, start, split, room, level + 1)
                start = split
        last = split
    return out + [last] * (last > start)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a section, each of at most limit tokens.

    A text over the limit is cut by the hierarchy of separators into parts that
    leave room for the overlap. Every part but the first is then led by the
    overlap tokens before it, moved back to the start of a word if there is one
    close by, so that at least overlap tokens are carried over. Every piece ends
    further than the one before.
    """
    room = limit * CHARS + CHARS - 1
    if len(text) <= room:
        return [(0, len(text))]
    if limit <= 2 * overlap:
        raise ValueError("the limit must be more than twice the overlap")
    carry = overlap * CHARS
    back = min(BACK, (room - carry) // 2)
    ends = _ends(text, 0, len(text), room - carry - back)
    # A first part of no more than an overlap is led by nothing, so it has room for the next part too.
    while len(ends) > 1 and ends[0] <= carry + back:
        del ends[0]
    out = [(0, ends[0])]
    for done, end in zip(ends, ends[1:]):
        start = done - carry
        word = next((at for at in range(start, start - back, -1) if text[at - 1].isspace() and not text[at].isspace()), start)
        out.append((max(word, out[-1][0] + 1), end))
    return out


def chunk(docs: DataFrame, id_col: str = "id", text_col: str = "content", limit: int = 450, overlap: int = 40) -> DataFrame:
    """(doc_id, piece_no, section_no, section_piece, heading_path, section_tokens, start, content, tokens_est, overlap_chars) of every piece.

    Sections and pieces of a document are numbered from 0, as are the pieces of
    a section (section_piece); start is the place of
    the piece in its section's text, and overlap_chars are its leading
    characters that the piece before holds too. tokens_est is the count of the
    piece itself. Documents with a null id or text, and texts of nothing but
    front matter, headings and white space, give no pieces; repeated rows give
    repeated pieces. Whole texts are cut in one pass over each partition,
    without a shuffle.
    """
    kinds = [("doc_id", pa.int64()), ("piece_no", pa.int32()), ("section_no", pa.int32()), ("section_piece", pa.int32()), ("heading_path", pa.string()), ("section_tokens", pa.int64()), ("start", pa.int64()), ("content", pa.string()), ("tokens_est", pa.int64()), ("overlap_chars", pa.int64())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                number = 0
                for k, (path, body) in enumerate(parse(text.as_py())):
                    size, end = count_tokens(body), 0
                    for part, (a, b) in enumerate(pieces(body, limit, overlap)):
                        rows.append((doc, number, k, part, path, size, a, body[a:b], count_tokens(body[a:b]), end - a if a else 0))
                        number, end, held = number + 1, b, held + b - a
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null and text <> ''")
    return spread(rows).mapInArrow(run, "doc_id long, piece_no int, section_no int, section_piece int, heading_path string, section_tokens long, start long, content string, tokens_est long, overlap_chars long")
