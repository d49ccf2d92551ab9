"""Token counts of a unigram vocabulary by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at each character; dynamic
programming carries the best score and the number of pieces of that segmentation, nothing else. Rules of the
exact tokenizer: a piece wins over those found before only with a strictly higher score, pieces that end at
a character are tried from the longest to the shortest; a character that is no piece itself may be unknown,
at the lowest score of the vocabulary less 10; unknown characters are written as their bytes if the
vocabulary has byte pieces, else neighbours count as one.

Texts are cut before each blank, as the tokenizer does: a blank becomes U+2581 and starts a new word. Words
are counted once per batch of texts and remembered up to a fixed number.

Defined results: a null or empty text has 0 tokens; repeated rows are counted each by itself; extra columns
stay untouched; texts of any length take time and memory in proportion to their longest word.
"""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 300_000

_MODELS: dict[str, object] = {}


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        scores = dict(reversed(vocabulary))  # of equal pieces the first counts
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        """Pieces of the best segmentation of one word."""
        n = len(word)
        reach: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(word):
            reach[end + 1].append(found)
        best: list[float] = [0.0] * (n + 1)
        pieces = [0] * (n + 1)
        open_unknown = [False] * (n + 1)  # the best segmentation ends with an unknown character
        for end in range(1, n + 1):
            found = reach[end]
            top = None
            for length, score in found:  # from the longest to the shortest
                start = end - length
                value = best[start] + score
                if top is None or value > top:
                    top, count, unknown = value, pieces[start] + 1, False
            if not found or found[-1][0] != 1:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    top, unknown = value, True
                    if self.bytes:
                        count = pieces[end - 1] + len(word[end - 1].encode())
                    else:
                        count = pieces[end - 1] + (not open_unknown[end - 1])
            best[end], pieces[end], open_unknown[end] = top, count, unknown
        return pieces[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", BLANK)
        if text[0] != BLANK:
            text = BLANK + text
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        words = text.split(BLANK)[1:]
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self.count_word(BLANK + w)
            return sum(map(known.__getitem__, words))


def vocabulary_of(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def with_token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of the whole text. The vocabulary, as long as its file, is broadcast."""
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(returnType="bigint")
    def counted(texts: pa.Array) -> pa.Array:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = UnigramCounter(shared.value)
        model = _MODELS[key]
        return pa.array([model.count(t.as_py() or "") for t in texts], pa.int64())

    return docs.withColumn(out, counted.asNondeterministic()(F.col(text)))
