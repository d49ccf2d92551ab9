"""Quality rules by distribution divergence.

A document's histograms of character classes and of a language's common words are compared with the
references of its language by the Jensen-Shannon distance (base 2, 0 to 1). Each comparison needs a
minimum length; shorter texts pass it. Fixed base rules reject very short and self-repeating texts.

Defined results: a null text has no words and fails the base rules; a null or unknown language is
compared with every reference and the nearest counts; extra columns stay untouched; repeated rows are
judged each by itself; an empty table stays empty.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.llm.common import bytes_of, fresh, words_of

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
#: length guards, limits of the two distances, and what small samples may add to them (over the root of the length)
MIN_CHARS, MAX_CLASS_DISTANCE, CLASS_SLACK = 80, 0.17, 1.8
MIN_COMMON_WORDS, MAX_WORD_DISTANCE, WORD_SLACK = 60, 0.25, 1.2

SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")
#: shares of the character classes in running prose, in the order of CLASSES (fixed values)
CLASS_REFERENCE = {
    "en": (0.780, 0.025, 0.006, 0.165, 0.022, 0.001, 0.001),
    "de": (0.795, 0.055, 0.006, 0.125, 0.017, 0.001, 0.001),
    "fr": (0.775, 0.025, 0.006, 0.165, 0.027, 0.001, 0.001),
    "es": (0.785, 0.025, 0.006, 0.160, 0.022, 0.001, 0.001),
}
#: relative frequencies of the commonest words, per mille of running text (fixed values)
WORD_REFERENCE = {
    "en": {"the": 61, "of": 31, "and": 28, "to": 26, "a": 22, "in": 21, "is": 11, "that": 11, "it": 10, "for": 9,
           "was": 9, "on": 7, "as": 7, "with": 7, "be": 6, "by": 6, "this": 5, "are": 5, "from": 4, "or": 4},
    "de": {"der": 32, "die": 31, "und": 28, "in": 18, "den": 11, "von": 10, "zu": 10, "das": 10, "mit": 9, "sich": 8,
           "des": 8, "auf": 8, "ist": 8, "im": 7, "dem": 7, "nicht": 7, "ein": 6, "eine": 6, "als": 6, "auch": 5},
    "fr": {"de": 47, "la": 28, "le": 24, "et": 23, "les": 20, "des": 17, "en": 14, "un": 12, "du": 12, "une": 11,
           "que": 9, "est": 9, "pour": 8, "qui": 8, "dans": 8, "par": 6, "sur": 6, "au": 6, "pas": 5, "avec": 4},
    "es": {"de": 56, "la": 34, "que": 27, "el": 26, "en": 25, "y": 24, "a": 19, "los": 15, "se": 12, "del": 11,
           "las": 10, "un": 9, "por": 8, "con": 8, "una": 7, "no": 7, "para": 6, "su": 6, "es": 6, "al": 5},
}
LANGUAGES = tuple(CLASS_REFERENCE)

RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "class_distance double, word_distance double, base_failed boolean, kept boolean"
)

_CLASS_OF = np.zeros(256, np.int64)
for _c in range(256):
    _CLASS_OF[_c] = (
        0 if 97 <= _c <= 122 or _c >= 0xC0 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57
        else 3 if _c == 32 or 9 <= _c <= 13 else 4 if chr(_c) in ".,;:!?'\"()-" else 5 if _c < 128 else 6
    )
_LEAD = np.ones(256, np.int64)
_LEAD[0x80:0xC0] = 0  # continuation bytes count with their first byte


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, each scaled to 1."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, (a + b) / 2)))


def _references() -> dict[str, tuple[np.ndarray, list[bytes], np.ndarray]]:
    out = {}
    for lang in LANGUAGES:
        shares = WORD_REFERENCE[lang]
        out[lang] = (np.array(CLASS_REFERENCE[lang]), [w.encode() for w in shares], np.array([*shares.values(), 1000 - sum(shares.values())]) / 1000)
    return out


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice in the sequence."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    # equal windows have equal hashes; those few are compared word by word
    at = np.sort(order[np.append(same, False) | np.append(False, same)])
    rows = ids[at[:, None] + np.arange(window)]
    _, group, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    hit = at[count[group.ravel()] >= 2]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def judge(text: bytes, lang: str | None, references: dict) -> tuple:
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    joined_chars = sum(map(len, words)) - int(counts[0x80:0xC0].sum())
    symbols = int(sum(counts[c] for c in SYMBOLS))
    repeated = 0
    length = max(1, len(text) - int(counts[0x80:0xC0].sum()))
    if n > WINDOW:
        ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
        repeated = repeated_words(np.fromiter(map(ids.__getitem__, words), np.uint64, n))
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n
    langs = [lang] if lang in references else LANGUAGES
    class_distance = word_distance = None
    if length >= MIN_CHARS:
        shape = np.bincount(_CLASS_OF, weights=counts * _LEAD, minlength=len(CLASSES))
        class_distance = min(js_distance(shape, references[x][0]) for x in langs) if shape.sum() else None
    if n >= MIN_COMMON_WORDS:
        bare = words_of(text)
        often = Counter(bare)
        found = []
        for x in langs:
            _, common, shares = references[x]
            seen = [often[w] for w in common]
            if bare:
                found.append(js_distance(np.array([*seen, len(bare) - sum(seen)], float), shares))
        word_distance = min(found, default=None)
    kept = (
        not failed
        and not (class_distance is not None and class_distance > MAX_CLASS_DISTANCE + CLASS_SLACK / length**0.5)
        and not (word_distance is not None and word_distance > MAX_WORD_DISTANCE + WORD_SLACK / n**0.5)
    )
    return n, joined_chars, symbols, duplicate_lines(text), repeated, class_distance, word_distance, failed, kept


def quality(text: Column, lang: Column) -> Column:
    """The struct RESULT of a whole text."""
    fields = pa.struct([
        *[(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ("class_distance", pa.float64()), ("word_distance", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ])
    names = [x.name for x in fields]

    @F.arrow_udf(returnType=RESULT)
    def measured(texts: pa.Array, langs: pa.Array) -> pa.Array:
        references = _references()
        rows = [judge(t.as_py(), x.as_py(), references) for t, x in zip(texts, langs, strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(names), fields, strict=True)],
            fields=list(fields),
        )

    return measured.asNondeterministic()(bytes_of(text), lang)


def with_quality(docs: DataFrame, text: str = "text", lang: str = "lang", out: str = "quality") -> DataFrame:
    """Adds the struct of signals and verdict; nothing is shuffled."""
    return docs.withColumn(out, quality(F.col(text), F.col(lang)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    (name,) = fresh(docs, "quality")
    return with_quality(docs, out=name).filter(F.col(f"{name}.kept")).drop(name)
