"""Per-document text statistics, and lists, tables and junk told apart from prose (problem 8).

A document's part outside code gives five distributions: function words of its likeliest language against other
words, numbers and marks; classes of characters; classes of line ends; words by the length of their line; and new
words against repeated ones. Each is compared with the profiles of prose, lists, tables and junk through the
Jensen–Shannon divergence, and the nearest profile gives the kind. Only documents that are not clearly nearest to
prose get a sixth distribution, the kinds of their lines. The work is one map over Arrow batches: no shuffle, and
the distributions of a whole batch are counted at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Common function words of each language.
FUNCTION_WORDS = {
    "en": """
    a an the and or but nor so yet if then than as at by for from in into of off on onto out over per to under up upon
    with without about after again all also am any are be because been before being between both can cannot could did
    do does each every few had has have he her here his how i is it its just like may me more most my neither never no
    not now one only other our same she should since some such that their them there these they this those through too
    until very was we were what when where which while who why will would you your
    """,
    "de": """
    der die das den dem des ein eine einen einem und oder aber wenn weil dass daß ist sind war nicht auch auf aus bei
    bis für im mit nach nur ohne seit sich sie es ich man uns um von vor warum wie wird zu zum zur noch über danach
    """,
    "fr": """
    le la les l un une des du de d et ou mais si que qui quoi est sont pas ne n se s sur sous sans avec chez dans dès
    en il elle ils je j nous vous on pour pourquoi puis plus au aux ce cette faut
    """,
    "es": """
    el los las lo una unos y o pero como con cuando del desde donde esta este está hay más me mi muy no nos para por
    porque qué se sigue sin sobre su sus ya al después primero
    """,
}
COMMON = frozenset(" ".join(FUNCTION_WORDS.values()).split())
#: Each function word with one bit for each language that has it.
_OF_LANGUAGE = {w: sum(1 << k for k, text in enumerate(FUNCTION_WORDS.values()) if w in text.split()) for w in COMMON}

#: Letters in classes of about equal use in the languages above.
LETTERS = {c: k for k, group in enumerate(("aeiouyàâäáåæéèêëíîïóôöœúùûü", "tnsrldñßç", "hcmpgfbv", "wjkqxz")) for c in group}
#: Marks that running text uses, those that end a sentence, and those that may close a line after it.
PROSE_MARKS, SENTENCE_MARKS, CLOSING = ".,;:!?'\"()…’‘“”«»–—¿¡`。，、！？：（）「」；", ".!?…。！？։؟", "*_`\"'”’»)]"

_CLASSES = str.maketrans({c: str(k) for c, k in LETTERS.items()})

KINDS = ("prose", "list", "table", "junk")

#: The profiles, several for a kind. Shares of function words, other words, numbers (the rest: marks); of
#: vowels, frequent, middling and rare letters, digits, prose marks (the rest: other marks); of lines that end a
#: sentence, or in a letter or digit (the rest: in another mark); of words in lines of up to 3, 6 and 11 words (the
#: rest: longer ones); of new words (the rest: repeated ones).
PROFILES = (
    ("prose", (0.37, 0.39, 0.01), (0.37, 0.36, 0.15, 0.04, 0.01, 0.06), (0.97, 0.02), (0.34, 0.25, 0.40), (0.97,)),
    ("prose", (0.36, 0.45, 0.02), (0.38, 0.36, 0.18, 0.03, 0.01, 0.03), (0.97, 0.02), (0.01, 0.01, 0.03), (0.75,)),
    ("prose", (0.38, 0.48, 0.02), (0.38, 0.36, 0.18, 0.03, 0.01, 0.03), (0.20, 0.77), (0.01, 0.08, 0.37), (0.75,)),
    ("list", (0.31, 0.53, 0.02), (0.39, 0.36, 0.17, 0.04, 0.01, 0.02), (0.01, 0.83), (0.01, 0.17, 0.81), (0.70,)),
    ("list", (0.03, 0.58, 0.03), (0.35, 0.33, 0.19, 0.03, 0.01, 0.07), (0.01, 0.81), (0.97, 0.01, 0.01), (0.95,)),
    ("table", (0.06, 0.20, 0.23), (0.20, 0.18, 0.10, 0.01, 0.28, 0.05), (0.01, 0.42), (0.20, 0.12, 0.67), (0.66,)),
    ("table", (0.08, 0.31, 0.31), (0.24, 0.21, 0.13, 0.02, 0.28, 0.09), (0.01, 0.95), (0.63, 0.35, 0.01), (0.69,)),
    ("junk", (0.01, 0.12, 0.01), (0.10, 0.02, 0.01, 0.01, 0.01, 0.18), (0.14, 0.01), (0.01, 0.02, 0.14), (0.50,)),
    ("junk", (0.06, 0.23, 0.01), (0.10, 0.27, 0.18, 0.01, 0.01, 0.08), (0.06, 0.01), (0.97, 0.01, 0.01), (0.06,)),
    ("junk", (0.11, 0.46, 0.18), (0.23, 0.14, 0.21, 0.11, 0.16, 0.06), (0.01, 0.96), (0.40, 0.02, 0.02), (0.58,)),
    ("junk", (0.38, 0.40, 0.02), (0.36, 0.33, 0.18, 0.03, 0.01, 0.08), (0.45, 0.50), (0.01, 0.01, 0.01), (0.05,)),
)
#: A document nearer to prose than to anything else by at least so much is prose without a look at its lines.
CLEAR = 0.04
#: About so many characters are counted at once; that changes no result.
AT_ONCE = 300_000
#: Weight of the distribution of line kinds where it is taken, and its share on a profile's own kind.
LINE_WEIGHT, OWN_LINES = 0.7, 0.94

_FENCE = re.compile(r"^[ \t>]*(`{3,}|~{3,}).*?(?:^[ \t>]*\1[^\n]*$|\Z)", re.S | re.M)
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_MARKUP = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|&(?:#\d+|#x[0-9a-fA-F]+|\w+);", re.S)
_HIDDEN = re.compile(r"[­​-‏‪-‮⁠-⁤︀-️﻿]")
_QUOTE = re.compile(r"^\s*(?:>\s?)+")
_LINK = re.compile(r"(?:https?|ftp)://\S+|www\.\S+", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_PART = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_MARKER = re.compile(r"^(?:[-*+•‣◦▪·–—o]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\])\s+")
_END = re.compile(r"[.!?…。！？։؟][\s\"'”’»)\]*_`]*$")
_CELLS = (re.compile(r"\t"), re.compile(r"\|"), re.compile(r";(?! )"), re.compile(r",(?! )"), re.compile(r" & "), re.compile(r"(?<=[^\s.!?…:;,]) {2,}(?=\S)"))
#: What text of a wrong encoding is full of.
_GARBLED = re.compile(r"[ÃÂÅâïð€™¤¶¿¡»«¼½¾]")
_RULE = re.compile(r"^[\s|+:=_-]{3,}$")
_BLOB = re.compile(r"^(?=\S*[\d+/A-Z])[A-Za-z0-9+/=_-]{24,}$|^[0-9a-fA-F]{8,}$")


def outside_code(text: str) -> list[str]:
    """The non-blank lines outside fenced and indented code, without hidden characters and quote marks."""
    body = text if text.isascii() else _HIDDEN.sub("", text)
    if "```" in body or "~~~" in body:
        body = _FENCE.sub("\n", body)
    lines = [x for x in _BREAK.split(body) if x and not x.isspace() and not x.startswith(("    ", "\t"))]
    if ">" in body:
        lines = [x for x in (_QUOTE.sub("", y) for y in lines) if x and not x.isspace()]
    return [x.rstrip() for x in lines]


def _row_lines(lines: list[str]) -> set[int]:
    """The lines that are rows of cells: at least two marks of one kind, as many as most other rows have, and
    few words to a cell."""
    best: set[int] = set()
    for mark in _CELLS:
        if not any(mark.search(x) for x in lines):
            continue
        counts = [len(mark.findall(x.strip())) for x in lines]
        usual = Counter(c for c in counts if c >= 2)
        if not usual:
            continue
        most, n = usual.most_common(1)[0]
        if n < 2:
            continue
        if mark is _CELLS[5]:  # columns set by blanks: an empty cell leaves one gap less
            rows = {k for k, c in enumerate(counts) if 1 <= c <= most + 1}
        else:
            rows = {k for k, c in enumerate(counts) if c == most}
        rows = {k for k in rows if len(lines[k].split()) <= 4 * (counts[k] + 1)}
        if len(rows) > len(best):
            best = rows
    return best


def _noisy(line: str, words: list[str], common: int) -> bool:
    """Links or markup alone, encoded blobs, and marks or letters that no language has in such shares."""
    rest = _MARKUP.sub(" ", _LINK.sub(" ", line)) if "<" in line or "&" in line or "://" in line or "www." in line else line
    tokens = rest.split()
    solid = "".join(tokens)
    dense, known = len(solid), sum(map(str.isalnum, solid))
    if not known:
        return True
    blobs = [t for t in tokens if _BLOB.match(t)]
    if sum(map(len, blobs)) > 0.5 * dense:
        return True
    if len(tokens) == 1 and dense > 40 and rest is line and _END.search(line) is None and line.isascii():
        return True
    if dense >= 8 and dense - known > 0.4 * dense:
        return True
    if not line.isascii() and len(_GARBLED.findall(line)) > 0.25 * dense:
        return True
    low = "".join(words)
    if len(low) >= 20:  # keys struck at random: rare letters, or hardly a vowel
        classes = low.translate(_CLASSES)
        letters = sum(classes.count(k) for k in "0123")
        if classes.count("3") > 0.15 * letters or (classes.count("0") < 0.2 * letters and common <= 0.06 * len(words)):
            return True
    return False


def _repeated(words: list[str]) -> bool:
    """One phrase over and over."""
    return len(words) >= 12 and len(set(words)) <= max(2, min(8, 0.15 * len(words)))


def _wrapped(body: list[str], short: list[int]) -> bool:
    """Whether all these lines end where the next word no longer fitted: prose in narrow columns, no items. Columns
    of text are at least 30 characters wide."""
    width = max(map(len, body))
    return width >= 30 and all(k + 1 == len(body) or len(body[k]) + 1 + len(body[k + 1].split()[0]) > width for k in short)


def line_kinds(body: list[str]) -> np.ndarray:
    """Characters in lines of each of ``KINDS``: sentences, items, rows of cells, noise."""
    rows = _row_lines(body)
    kinds = np.zeros(4)
    all_words: list[str] = []
    short: list[int] = []
    size = [len("".join(line.split())) for line in body]
    for k, line in enumerate(body):
        bare = _MARKUP.sub(" ", _LINK.sub(" ", line)) if "<" in line or "&" in line or "://" in line else line
        low = _PART.findall(bare.lower())
        common = sum(map(COMMON.__contains__, low))
        all_words += low
        clean = line.strip().rstrip("*_`")
        ends = _END.search(clean)
        if k in rows or (rows and _RULE.match(line)):
            kind = 2
        elif _noisy(line, low, common):
            kind = 3
        elif not ends and _MARKER.match(clean):
            kind = 1
        elif ends or clean.endswith(":") or len(low) >= 7 or (len(low) >= 3 and common >= 0.3 * len(low)):
            kind = 0
        else:
            kind = 1
            short.append(k)
        if k or not clean.endswith(":") or len(body) < 3:  # a line of introduction changes nothing
            kinds[kind] += size[k]
    if kinds[0] and short and not rows and _wrapped(body, short):
        moved = sum(size[k] for k in short)
        kinds[0], kinds[1] = kinds[0] + moved, kinds[1] - moved
    if _repeated(all_words):
        kinds = np.array([0.0, 0.0, 0.0, 1.0])
    if kinds[1] and short and len(body) < 3:  # one or two short lines are no list
        kinds[0], kinds[1] = kinds[0] + kinds[1], 0
    return kinds


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane its class (4 digit, 5 prose mark, 6 other mark, 7 letter of another
    script, 8 blank, 9 line feed; letters as in ``LETTERS``) and what it says at a line's end (0 sentence, 1 letter or
    digit, 2 other mark, 3 nothing)."""
    kind, end = np.empty(0x10000, np.int8), np.empty(0x10000, np.int8)
    for k in range(0x10000):
        c = chr(k)
        low = c.lower()
        kind[k] = (
            9 if c == "\n" else 8 if c.isspace() else LETTERS[low] if low in LETTERS else 7 if c.isalpha() else 4 if c.isdigit()
            else 5 if c in PROSE_MARKS else 6
        )
        end[k] = 3 if c.isspace() or c in CLOSING else 0 if c in SENTENCE_MARKS else 1 if c.isalnum() else 2
    return kind, end


def shapes(bodies: list[list[str]]) -> list[np.ndarray]:
    """The five distributions of each body, as counts: one matrix each, a row a body."""
    m = len(bodies)
    texts = ["\n".join(b) for b in bodies]
    code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, end = _tables()
    c, e = (np.where(code < 0x10000, t[np.minimum(code, 0xFFFF)], far).astype(np.int8) for t, far in ((kinds, 6), (end, 2)))
    doc = np.repeat(np.arange(m, dtype=np.int32), [len(t) + 1 for t in texts])
    chars = np.bincount(doc * 10 + c, minlength=10 * m).reshape(m, 10)
    at = np.arange(len(c), dtype=np.int32)
    stop = np.flatnonzero(c == 9)
    start = np.append(0, stop[:-1] + 1)
    last = np.maximum.accumulate(np.where(e != 3, at, -1))[stop]
    ends = np.bincount(doc[stop] * 3 + np.where(last >= start, e[np.maximum(last, 0)], 2), minlength=3 * m).reshape(m, 3)
    before = np.append(np.int8(9), c[:-1])
    begins = np.cumsum((c < 8) & (before >= 8), dtype=np.int32)
    words = begins[stop] - np.append(0, begins[stop[:-1]])
    lengths = np.bincount(doc[stop] * 4 + np.searchsorted([3, 6, 11], words), words, 4 * m).reshape(m, 4)
    numbers = np.bincount(doc, (c == 4) & (before != 4), m)
    tokens, novelty = np.zeros((m, 4)), np.zeros((m, 2))
    for k, text in enumerate(texts):
        found = _PART.findall(text.lower())
        of = Counter(map(_OF_LANGUAGE.get, found))
        del of[None]
        common = max((sum(n for bits, n in of.items() if bits >> j & 1) for j in range(len(FUNCTION_WORDS))), default=0)
        new = len(set(found))
        tokens[k, :2] = common, len(found) - common
        novelty[k] = new, len(found) - new
    tokens[:, 2], tokens[:, 3] = numbers, chars[:, 5] + chars[:, 6]
    return [tokens, chars[:, :7].astype(float), ends.astype(float), lengths, novelty]


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen–Shannon divergence in bits of each row of counts ``p`` from the shares ``q``; 0 for rows of zeros."""
    total = p.sum(1, keepdims=True)
    p = p / np.where(total > 0, total, 1)
    m = (p + q) / 2
    part = np.where(p > 0, p * np.log2(np.where(p > 0, p, 1) / m), 0.0).sum(1) + (q * np.log2(q / m)).sum(1)
    return np.where(total[:, 0] > 0, part / 2, 0.0)


def by_kind(parts: list[np.ndarray]) -> np.ndarray:
    """For each row and each of ``KINDS`` the mean divergence of the distributions from its nearest profile."""
    whole = lambda q: np.array([*q, 1 - sum(q)])
    each = np.stack([sum(divergence(x, whole(q)) for x, q in zip(parts, p[1:])) / len(parts) for p in PROFILES], 1)
    return np.stack([each[:, [p[0] == k for p in PROFILES]].min(1) for k in KINDS], 1)


def kinds_of(bodies: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """For each body the place of its kind in ``KINDS`` and its divergence from it; ties go to the earlier kind."""
    scored = by_kind(shapes(bodies))
    doubt = np.flatnonzero(scored[:, 0] > scored[:, 1:].min(1) - CLEAR)
    if len(doubt):
        lines = np.stack([line_kinds(bodies[k]) for k in doubt])
        own = np.full((4, 4), (1 - OWN_LINES) / 3) + np.eye(4) * (OWN_LINES - (1 - OWN_LINES) / 3)
        far = np.stack([divergence(lines, q) for q in own], 1)
        scored[doubt] = LINE_WEIGHT * far + (1 - LINE_WEIGHT) * scored[doubt]
    best = scored.argmin(1)
    return best, scored[np.arange(len(best)), best]


def counts(text: str | None) -> dict:
    """The basic counts of a whole text."""
    out = dict.fromkeys(("words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "divergence", "kind"))
    if text is None:
        return out
    shown = text if text.isascii() else _HIDDEN.sub("", text)
    words = _WORD.findall(shown)
    lines = [x for x in _BREAK.split(shown) if x.strip()]
    dense = "".join(shown.split())
    out["words"] = len(words)
    out["mean_word_length"] = sum(map(len, words)) / len(words) if words else None
    out["symbol_ratio"] = (len(dense) - sum(map(str.isalnum, dense))) / len(dense) if dense else None
    out["punctuated_lines"] = sum(bool(_END.search(x)) for x in lines) / len(lines) if lines else None
    out["common_words"] = sum(w.lower() in COMMON for w in words) / len(words) if words else None
    return out


def _told(texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Places of the texts with anything outside code, the places of their kinds, and their divergences."""
    bodies = [(k, b) for k, b in ((k, outside_code(t)) for k, t in enumerate(texts) if t) if b]
    if not bodies:
        return [], np.zeros(0, int), np.zeros(0)
    size = np.cumsum([sum(map(len, b)) for _, b in bodies])
    edges = np.flatnonzero(np.diff(size // AT_ONCE, append=-1)) + 1  # after so many characters each
    parts = [kinds_of([b for _, b in bodies[lo:hi]]) for lo, hi in zip([0, *edges[:-1]], edges)]
    return [k for k, _ in bodies], *map(np.concatenate, zip(*parts))


def figures_of(texts: list[str | None]) -> list[dict]:
    """All figures of each text; the kinds of all texts are told at once."""
    found = [counts(t) for t in texts]
    for k, b, f in zip(*_told(texts)):
        found[k].update(kind=KINDS[b], divergence=float(f))
    return found


def figures(text: str | None) -> dict:
    return figures_of([text])[0]


FIGURES = (
    "words long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, "
    "divergence double, kind string"
)


def text_figures(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the figures of each document's whole text.

    A null text has null figures; an empty or blank one has 0 words and otherwise nulls; neither has a kind, nor
    has a text with nothing outside code. Other columns are ignored; repeated rows come out as often as they
    occur; an empty table gives none.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = pd.DataFrame(figures_of(list(rows["text"])), columns=[c.split()[0] for c in FIGURES.split(", ")])
            found.insert(0, "doc_id", rows["doc_id"].to_numpy())
            found["words"] = found["words"].astype("Int64")
            yield found

    return documents.select("doc_id", "text").mapInPandas(work, "doc_id long, " + FIGURES)


def not_prose(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``kind`` of the documents that are lists, tables or junk; null, empty and blank texts and those
    with nothing outside code are none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kind, _ = _told(b.column("text").to_pylist())
            some = np.flatnonzero(kind)
            ids = b.column("doc_id").take(pa.array(np.array(at, np.int64)[some]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([KINDS[k] for k in kind[some]], pa.string())], ["doc_id", "kind"])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id long, kind string")
