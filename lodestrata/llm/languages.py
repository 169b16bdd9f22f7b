"""Language of documents and of the stretches in them, by rank-order profiles.

A language's profile ranks the n-grams of its samples by frequency. A sentence's
n-grams are ranked the same way, and its distance to a language is the sum of
how far each is out of its place in the profile, at most the profile's length.
Sentences of a small margin follow those around them; runs of one language are
the segments. Scoring is a few array operations over whole batches of texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import materialize, spread

# Names that a label may use for each language (two letters, three letters, English).
NAMES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"),
    "nl": ("nld", "dut", "dutch"),
    "it": ("ita", "italian"),
    "pl": ("pol", "polish"),
    "sv": ("swe", "swedish"),
    "da": ("dan", "danish"),
    "ru": ("rus", "russian"),
}
#: Labels that name no one language.
NAMELESS = ("", "-", "und", "mul", "unknown", "none", "null", "n/a", "zxx", "mis")

#: N-grams of a profile; what a change of language costs between two sentences, in profile lengths out of place.
PROFILE, SWITCH = 1000, 6.0
#: Rank of an n-gram that a profile does not have.
_ABSENT = 32000
#: Symbols scored at once.
CHUNK = 400_000
_LETTERS = 128
#: Symbols above this one stand for the letters of a block of 256 code points that the samples do not have.
_OWN = 103
_GRAMS = _LETTERS**3
#: Inline code, quoted or bracketed terms: part of a sentence, not of its language.
_ASIDE = re.compile(r"`[^`\n]*`|\([^()\n]{1,60}\)|\"[^\"\n]{1,60}\"")
_FENCE = re.compile(r"^[ \t>]*```[^\n]*(?:\n(?![ \t>]*```)[^\n]*)*(?:\n[ \t>]*```[^\n]*|\Z)", re.MULTILINE)
_DOCUMENT = "\x02"
#: Kinds of characters, as bits.
_BLANK, _LINE, _STOP, _CLOSER, _ODD, _INNER, _MARK, _QUOTE = (1 << k for k in range(8))


def _kinds() -> np.ndarray:
    table = np.zeros(0x3000, np.uint8)
    for bit, chars in ((_LINE, "\n\r\v\f\x85\u2028\u2029"), (_STOP, ".!?\u2026"), (_CLOSER, "\"')]*_`\u00bb\u201d\u2019"), (_ODD, "0123456789_/\\@"), (_INNER, ".:"), (_MARK, "#-*+|=~0123456789"), (_QUOTE, ">")):
        for c in chars:
            table[ord(c)] |= bit
    for i in range(0x3000):
        if chr(i).isspace():
            table[i] |= _BLANK
    table[2] |= _BLANK | _LINE
    return table


_KINDS = _kinds()


def alphabet(texts: list[str]) -> np.ndarray:
    """Symbol of each code point below 0x3000, and of one of each block above: 0 for what is no letter, cases alike.

    The most frequent letters of the texts have symbols of their own; any other
    letter has that of its block, so that scripts without samples, and those of
    very many letters, still differ.
    """
    seen = Counter(c for t in texts for c in t.lower() if c.isalpha() and ord(c) < 0x3000)
    table = np.zeros(0x3000, np.uint8)
    for i in range(0x3000):
        if chr(i).isalpha():
            table[i] = _block(np.array([i]))[0]
    for k, (c, _) in enumerate(sorted(seen.items(), key=lambda e: (-e[1], e[0]))[: _OWN - 1], 1):
        for form in {c, c.upper()}:
            if len(form) == 1 and ord(form) < len(table):
                table[ord(form)] = k
    return table


def _block(codes: np.ndarray) -> np.ndarray:
    return (_OWN + (codes >> 8) % (_LETTERS - _OWN)).astype(np.uint8)


def _symbols(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = _block(codes)
    low = codes < len(table)
    out[low] = table[codes[low]]
    # A capital A with tilde before what no word goes on with is the trace of a wrong decoding, unless capitals lead to it.
    for at in np.flatnonzero(codes == 0xC3):
        after = codes[at + 1] if at + 1 < len(codes) else 32
        if 0x80 <= after < 0xC0 or not chr(after).isalpha() and not (at and chr(codes[at - 1]).isupper()):
            out[at] = 0
    return out


def _grams(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, n-gram) of all runs of three symbols around a letter; symbols have single zeros between words."""
    s = symbols.astype(np.int64)
    a, b, c = s[:-2], s[1:-1], s[2:]
    own = owner[1:-1]
    keep = (b > 0) & ((owner[:-2] == own) | (a == 0)) & ((owner[2:] == own) | (c == 0))
    return own[keep], ((a * _LETTERS + b) * _LETTERS + c)[keep]


def _ranked(owner: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, rank) of the distinct n-grams of each owner, most frequent first; ties share their middle rank."""
    keys = (owner.astype(np.int64) << 21) | grams
    if not len(keys):
        return keys, keys, keys
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = np.diff(np.r_[first, len(keys)])
    keys = keys[first]
    own = keys >> 21
    order = np.argsort((own << 20) - np.minimum(counts, (1 << 20) - 1), kind="stable")
    own, counts, keys = own[order], counts[order], keys[order]
    start = np.r_[True, own[1:] != own[:-1]]
    tie = start | np.r_[True, counts[1:] != counts[:-1]]
    place = np.arange(len(own)) - np.maximum.accumulate(np.where(start, np.arange(len(own)), 0))
    at = np.flatnonzero(tie)
    length = np.diff(np.r_[at, len(own)])
    return own, keys & (_GRAMS - 1), np.repeat(place[at] + (length - 1) // 2, length)


@dataclass
class Profiles:
    """Ranks of the n-grams of each language, in one table."""

    langs: list[str]
    size: int
    ranks: np.ndarray
    table: np.ndarray

    def distances(self, symbols: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n x languages) mean out-of-place distances over the size, and the n-grams of each of n owners."""
        total = np.zeros((n, len(self.langs)), np.int64)
        grams = np.zeros(n, np.int64)
        at = 0
        while at < len(symbols):
            end = min(len(symbols), at + CHUNK)
            if end < len(symbols):
                # Back to the start of a sentence, unless one fills the chunk.
                begin = int(np.searchsorted(owner[at:end], owner[end])) + at
                end = begin if begin > at else end
            own, gram, rank = _ranked(*_grams(symbols[at:end], owner[at:end]))
            if len(own):
                places = np.minimum(np.abs(self.ranks.take(gram, axis=0) - np.minimum(rank, self.size)[:, None].astype(np.int16)), self.size)
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                np.add.at(total, own[first], np.add.reduceat(places, first, axis=0, dtype=np.int32))
                np.add.at(grams, own[first], np.diff(np.r_[first, len(own)]))
            at = end
        return total / np.maximum(grams, 1)[:, None] / self.size, grams


def _breaks(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where sentences end: white space after closing marks, blank lines, lines before or of a heading, item, rule or number."""
    n = len(codes)
    at = np.arange(n)
    blank, line = (kinds & _BLANK) > 0, (kinds & _LINE) > 0
    base = np.maximum.accumulate(np.where((kinds & _CLOSER) > 0, -1, at))
    before = np.r_[-1, base[:-1]]
    ends = blank & (before >= 0) & ((kinds[np.maximum(before, 0)] & _STOP) > 0) & ~np.r_[True, blank[:-1]]
    # The first character of each line that is neither blank nor a mark of quotation, and whether it comes before the next line.
    lines = np.flatnonzero(line)
    solid = (~blank & ((kinds & _QUOTE) == 0)) | line
    following = n - 1 - np.maximum.accumulate(np.where(solid[::-1], at, -1))[::-1]
    after = following[np.minimum(lines + 1, n - 1)]
    stops = line[np.minimum(after, n - 1)] | ((kinds[np.minimum(after, n - 1)] & _MARK) > 0)
    heads = np.r_[codes[following[0]] == ord("#"), codes[after[:-1]] == ord("#")] if len(lines) else np.empty(0, bool)
    ends[lines[stops | heads]] = True
    ends[codes == 2] = True
    return ends


def _prepared(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined: symbols with single zeros between words, the sentence of each; and of each sentence the text and the place in it."""
    marked = []
    for t in texts:
        if _DOCUMENT in t:
            t = t.replace(_DOCUMENT, " ")
        if "```" in t:
            t = _FENCE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), t)
        if "`" in t or "(" in t or '"' in t:
            t = _ASIDE.sub(lambda m: " " * len(m[0]), t)
        marked.append(t)
    codes = np.frombuffer((_DOCUMENT.join(marked) + _DOCUMENT).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < len(_KINDS)
    kinds = np.zeros(len(codes), np.uint8)
    kinds[low] = _KINDS[codes[low]]
    symbols = _symbols(codes, table)
    # Words with digits, slashes, underscores or inner stops are code, paths, numbers or names.
    blank = (kinds & _BLANK) > 0
    odd = ((kinds & _ODD) > 0) | (((kinds & _INNER) > 0) & np.r_[symbols[1:] > 0, False])
    word = np.cumsum(blank)
    symbols[(np.bincount(word, weights=odd) > 0)[word]] = 0
    ends = np.flatnonzero(_breaks(codes, kinds))
    closes = codes[ends] == 2
    document = np.r_[0, np.cumsum(closes)[:-1]]
    starts = np.r_[0, ends[:-1] + 1]
    place = starts - starts[np.r_[0, np.flatnonzero(closes)[:-1] + 1]][document]
    sentence = np.repeat(np.arange(len(ends)), np.diff(np.r_[-1, ends]))
    keep = (symbols > 0) | np.r_[False, symbols[:-1] > 0]
    symbols, sentence = symbols[keep], sentence[keep]
    return np.r_[np.uint8(0), symbols], np.r_[sentence[:1], sentence], document, place


def _fit(labelled_texts: list[tuple[str, str]], size: int, table: np.ndarray | None = None) -> Profiles:
    langs = sorted({lang for lang, _ in labelled_texts})
    table = alphabet([t for _, t in labelled_texts]) if table is None else table
    ranks = np.full((_GRAMS, len(langs)), _ABSENT, np.int16)
    for k, lang in enumerate(langs):
        symbols, _, _, _ = _prepared([t for of, t in labelled_texts if of == lang], table)
        _, gram, rank = _ranked(*_grams(symbols, np.zeros(len(symbols), np.int64)))
        ranks[gram[:size], k] = rank[:size]
    return Profiles(langs, size, ranks, table)


def _trusted(samples: DataFrame, lang_col: str, text_col: str, most: int) -> list[tuple[str, str]]:
    return [(r[0], r[1]) for r in samples.select(lang_col, text_col).dropna().orderBy(lang_col, text_col).limit(most).collect()]


def fit_profiles(samples: DataFrame, lang_col: str = "lang", text_col: str = "text", max_samples: int = 100_000, size: int = PROFILE) -> Profiles:
    """Profiles, and the alphabet they are of, from at most max_samples labelled rows, the first by language and text; rows with a null are not used."""
    rows = _trusted(samples, lang_col, text_col, max_samples)
    if not rows:
        raise ValueError("there are no samples to fit profiles on")
    return _fit(rows, size)


def refit_profiles(profiles: Profiles, samples: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_lang: int = 100, chars: int = 4000, size: int = PROFILE, sample_lang_col: str = "lang", sample_text_col: str = "text", max_samples: int = 100_000) -> Profiles:
    """Profiles refitted on trusted samples and a bounded sample of labelled documents.

    Of each language the per_lang documents labelled with it that come first by
    a hash of their id, of 200 to chars characters, are taken; those that the
    given profiles find to be of that one language only are used. So at most
    languages * per_lang * chars characters reach the driver, beside the same
    max_samples samples that fit_profiles() takes. Other languages than those of
    the profiles are not fitted. Without documents the profiles are those of the
    samples.
    """
    label = labelled(F.col(label_col))
    able = docs.select(F.col(text_col).alias("text"), label.alias("label"), F.xxhash64(id_col).alias("order")).where(F.col("label").isin(*profiles.langs) & F.char_length("text").between(200, chars))
    picked = able.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("order", "text"))).where(F.col("place") <= per_lang).select("label", "text")
    rows = sorted(picked.collect())
    found: dict[int, set] = {}
    for d, _, _, _, lang, _, _ in _segments(profiles, [r[1] for r in rows]):
        found.setdefault(d, set()).add(lang)
    trusted = [r for r in _trusted(samples, sample_lang_col, sample_text_col, max_samples) if r[0] in profiles.langs]
    return _fit(trusted + [(r[0], r[1]) for d, r in enumerate(rows) if found.get(d) == {r[0]}], size, profiles.table)


def _course(cost: np.ndarray) -> np.ndarray:
    """The language of each sentence on the course of the least cost, where every change costs SWITCH."""
    least = cost - cost.min(1, keepdims=True)
    back = np.empty(cost.shape, np.int64)
    total = least[0]
    stay = np.arange(cost.shape[1])
    for k in range(1, len(least)):
        low = int(total.argmin())
        change = total[low] + SWITCH
        kept = total <= change
        back[k] = np.where(kept, stay, low)
        total = np.where(kept, total, change) + least[k]
    out = np.empty(len(cost), np.int64)
    out[-1] = total.argmin()
    for k in range(len(cost) - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


def _segments(profiles: Profiles, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, float, int]]:
    """(text, segment, start, end, lang, confidence, sentences) of each segment."""
    symbols, sentence, document, place = _prepared(texts, profiles.table)
    distance, grams = profiles.distances(symbols, sentence, len(document))
    some = np.flatnonzero(grams)
    if not len(some):
        return
    distance, grams, doc, start = distance[some], grams[some], document[some], place[some]
    n = len(doc)
    first = np.r_[True, doc[1:] != doc[:-1]]
    cost = distance * grams[:, None]
    best = cost.argmin(1)
    # Texts whose sentences do not agree take the cheapest course through them.
    heads = np.flatnonzero(first)
    agree = np.minimum.reduceat(best, heads) == np.maximum.reduceat(best, heads)
    for at, end in zip(heads[~agree].tolist(), np.r_[heads[1:], n][~agree].tolist()):
        best[at:end] = _course(cost[at:end])
    opens = np.flatnonzero(first | np.r_[True, best[1:] != best[:-1]])
    length = np.diff(np.r_[opens, n])
    summed = np.add.reduceat(distance * grams[:, None], opens, axis=0) / np.add.reduceat(grams, opens)[:, None]
    own = summed[np.arange(len(opens)), best[opens]]
    summed[np.arange(len(opens)), best[opens]] = np.inf
    rival = summed.min(1) if summed.shape[1] > 1 else np.ones(len(opens))
    confidence = np.where(np.isinf(rival), 1.0, 1 / (1 + np.exp(-40 * (np.where(np.isinf(rival), 1, rival) - own))))
    head = first[opens]
    number = np.arange(len(opens)) - np.maximum.accumulate(np.where(head, np.arange(len(opens)), 0))
    docs = doc[opens].tolist()
    starts = np.where(head, 0, start[opens]).tolist()
    for k, d in enumerate(docs):
        end = starts[k + 1] if k + 1 < len(docs) and docs[k + 1] == d else len(texts[d])
        yield d, int(number[k]), starts[k], end, profiles.langs[best[opens[k]]], float(confidence[k]), int(length[k])


def language_segments(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, segment_no, start, end, lang, confidence, n_sentences): the stretches of one language of each text, covering all of it.

    Every text with a letter outside fenced code and asides has a segment 0, so
    texts that are null, empty or without words have no rows, and rows with a
    null id neither; repeated rows give repeated segments. One pass over each
    partition without a shuffle; texts are scored by bounded chunks, whatever
    their length. confidence is between 0 and 1, from the margin to the next
    language.
    """
    kinds = [("doc_id", pa.int64()), ("segment_no", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int64())]
    langs, size, table = profiles.langs, profiles.size, profiles.table
    at = np.flatnonzero((profiles.ranks < _ABSENT).any(1)).astype(np.int64)
    known = profiles.ranks[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.full((_GRAMS, len(langs)), _ABSENT, np.int16)
        ranks[at] = known
        own = Profiles(langs, size, ranks, table)
        for batch in batches:
            ids, texts = batch["id"].to_pylist(), batch["text"]
            k = 0
            while k < len(ids):
                part, held, base = [], 0, k
                while k < len(ids) and (not part or held < 1_000_000):
                    part.append(texts[k].as_py())
                    held, k = held + len(part[-1]), k + 1
                rows = [(ids[base + d], *rest) for d, *rest in _segments(own, part)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds)], schema=pa.schema(kinds))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null and text <> ''")
    return spread(rows).mapInArrow(run, "doc_id long, segment_no int, start long, end long, lang string, confidence double, n_sentences long")


def labelled(label: Column) -> Column:
    """The two-letter code that a label names in any notation; null where it names none, the label itself where it names another."""
    base = F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"[-_].*$", "")
    whole = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = F.when(whole.isin(*NAMELESS) | base.isin(*NAMELESS), F.lit(None))
    for code, names in NAMES.items():
        out = out.when(base.isin(code, *names), code)
    return out.otherwise(base)


def relabelled(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """segments of the documents whose label (lang) is missing, names another language than segment 0, or that hold several.

    doc_id must be unique in docs; a document without segments has no case.
    """
    # Read twice below: found once.
    segments = materialize(segments)
    first = segments.groupBy("doc_id").agg(F.min(F.struct("segment_no", "lang")).alias("first"), F.max("segment_no").alias("last"))
    label = docs.select(F.col("doc_id"), labelled(F.col("lang")).alias("label"))
    wrong = label.join(first, "doc_id").where("label is null or label <> first.lang or last > 0").select("doc_id")
    return segments.join(wrong, "doc_id", "left_semi")
