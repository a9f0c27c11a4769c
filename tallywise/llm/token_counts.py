"""Greedy word-piece lengths by a linear longest-match automaton.

A trie of the vocabulary gets failure links and, for each state, the number of tokens popped when the match fails
there, so that a word's token count falls out of one walk over its characters without building a piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

START = "▁"
CACHED_WORDS = 500_000


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece vocabulary file (no byte, control or unknown pieces)."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]


class Automaton:
    """Counts tokens of START + word by greedy longest match; a character outside the vocabulary costs its UTF-8 bytes."""

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            state = 0
            for c in piece:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                state = self.next[state][c]
            ends[state] = bool(piece)
        self.fail, self.popped = [0] * len(self.next), [0] * len(self.next)
        level = [(0, c, v) for c, v in self.next[0].items()]
        while level:
            deeper = []
            for parent, c, v in level:
                if ends[v]:
                    self.fail[v], self.popped[v] = 0, 1
                elif not parent:
                    self.fail[v], self.popped[v] = 0, len(c.encode())
                else:
                    state, popped = self.fail[parent], self.popped[parent]
                    while c not in self.next[state] and state:
                        popped += self.popped[state]
                        state = self.fail[state]
                    if c in self.next[state]:
                        self.fail[v], self.popped[v] = self.next[state][c], popped
                    else:
                        self.fail[v], self.popped[v] = 0, popped + len(c.encode())
                deeper += [(v, x, w) for x, w in self.next[v].items()]
            level = deeper

    def count(self, word: str) -> int:
        state, n = 0, 0
        for c in START + word:
            while state and c not in self.next[state]:
                n += self.popped[state]
                state = self.fail[state]
            if c in self.next[state]:
                state = self.next[state][c]
            else:
                n += len(c.encode())
        while state:
            n += self.popped[state]
            state = self.fail[state]
        return n


class _Counts(dict):
    """Word to count; forgets everything when it is full, so its memory is bounded."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        n = self.automaton.count(word.decode())
        if len(word) <= 64:
            self[word] = n
        return n


#: Bytes of a text whose words are held at once, but for a word that is longer.
SLICE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text in lists, each of about ``size`` bytes of it."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_tokens (both long).

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts count 0 and 0; repeated rows each give a row; an empty
    table gives none; other columns are ignored whatever their names. Whole texts are read; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(Automaton(vocabulary(vocabulary_path)))
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1).cast(pa.binary()):
                words = tokens = 0
                for found in _words(text.as_py() or b""):
                    words += len(found)
                    tokens += sum(map(counts.__getitem__, found))
                n_words.append(words)
                n_tokens.append(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], [id_col, "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long")
