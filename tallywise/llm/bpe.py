"""Byte-level BPE ids of whole text columns, encoding each distinct stretch of text once.

The pre-tokeniser never joins text across certain places (a space before a visible character; a single line break
between visible characters; changes between ASCII letters, digits and punctuation), so a text's ids are those of the
stretches between them. Distinct stretches are encoded with the merges of a ``tokenizers`` file and kept by hash.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from .textkit import pieces, run_hashes

CACHED_STRETCHES = 300_000
SPACE, BREAK, LETTER, DIGIT, MARK, LEAD, OTHER = 0, 1, 2, 3, 4, 5, 6
KIND = np.full(256, OTHER, np.uint8)
KIND[0x21:0x7F] = MARK
KIND[0x30:0x3A] = DIGIT
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x27] = OTHER  # contractions join an apostrophe to letters
KIND[0x09:0x0E] = BREAK
KIND[0x20] = SPACE
KIND[0xC3:0xE0] = LEAD  # two-byte characters above U+00BF: none is white space
#: Kinds that are surely visible when they begin a character.
SEEN = np.zeros(256, bool)
SEEN[[LETTER, DIGIT, MARK, LEAD]] = True


def stretch_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks the first byte of each stretch. Only places where the pre-tokeniser always cuts are marked."""
    n = len(data)
    kind = KIND[data]
    begins = np.zeros(n, bool)  # rows
    begins[offsets[:-1][offsets[:-1] < n]] = True
    visible = SEEN[kind] | (data == 0x27)
    ends_visible = (kind == LETTER) | (kind == DIGIT) | (kind == MARK) | (data == 0x27)
    ends_visible[1:] |= (data[1:] >= 0x80) & (kind[:-1] == LEAD)
    white = (kind == SPACE) | (kind == BREAK)
    start = begins.copy()
    start[:-1] |= (kind[:-1] == SPACE) & visible[1:] & ~begins[1:]
    after_visible = np.zeros(n, bool)
    after_visible[1:] = white[1:] & ends_visible[:-1]
    start |= after_visible
    start[1:] |= visible[1:] & (kind[:-1] == BREAK) & (after_visible | begins)[:-1]
    plain = (kind >= LETTER) & (kind <= MARK)
    start[1:] |= plain[1:] & plain[:-1] & (kind[1:] != kind[:-1])
    return start


#: Fixed value: the pre-tokeniser's pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def added_tokens(path: str) -> dict[bytes, int]:
    """The added tokens of a ``tokenizers`` file, which it finds inside texts, and their ids."""
    found = _file(path).get("added_tokens") or []
    odd = [t["content"] for t in found if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] and not t["special"]]
    if odd:
        raise ValueError(f"{path}: added tokens that take in neighbouring text or match normalised text: {odd}")
    return {t["content"].encode(): t["id"] for t in found}


def engine(path: str):
    """text -> ids of a byte-level BPE file of the ``tokenizers`` library, whose ids are its merge ranks.

    The file's vocabulary runs in tiktoken, which merges the uncached stretches in less than half the time; the ids
    are those of ``tokenizers`` without special tokens.
    """
    import tiktoken

    vocabulary, added = _file(path)["model"]["vocab"], added_tokens(path)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(map(byte_of.__getitem__, token)): k for token, k in vocabulary.items() if token.encode() not in added and all(c in byte_of for c in token)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _alone(t: bytes) -> bool:
    """Whether a stretch surely begins with a visible character, but for one space, ends with one and has no line break."""
    head = t[1:2] if t[:1] == b" " else t[:1]
    return bool(head) and (SEEN[KIND[head[0]]] or head == b"'") and b"\n" not in t and (0x20 < t[-1] < 0x7F or len(t) > 1 and 0xC3 <= t[-2] <= 0xDF)


class Encoder:
    """Ids of each row of a text column, as uint32 arrays; keeps a bounded number of distinct stretches.

    With ``added``, the file's added tokens inside texts get their own ids, as ``tokenizers`` does by itself; without,
    they are text like any other (its ``encode_special_tokens``).
    """

    def __init__(self, path: str, added: bool = False):
        self.ids = engine(path)
        self.added = added_tokens(path) if added else {}
        self.mark = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        self.line = self.ids("\n")[0]
        self.forget()

    def forget(self):
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.size, self.pool, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.keys, keys)
        found = np.full(len(keys), -1, np.int64)
        there = np.flatnonzero(place < len(self.keys))
        there = there[self.keys[place[there]] == keys[there]]
        found[there] = self.slots[place[there]]
        return found

    def learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        """Adds stretches (keys ascend). Those that are visible up to their ends and hold no line break go to the
        tokenizer joined by line breaks, which always stand alone there; the others go one by one."""
        size, parts = np.zeros(len(texts), np.int64), []
        odd = [k for k, t in enumerate(texts) if not _alone(t) or t in self.added]
        apart = set(odd)
        plain = [k for k in range(len(texts)) if k not in apart]
        for a in range(0, len(plain), 20_000):
            own = plain[a : a + 20_000]
            ids = np.array(self.ids(b"\n".join([texts[k] for k in own]).decode()), np.uint32)
            cut = np.flatnonzero(ids == self.line)
            assert len(cut) == len(own) - 1
            size[own] = np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1
            parts.append(np.delete(ids, cut))
        for k in odd:
            own = self.added.get(texts[k])
            ids = np.array(self.ids(texts[k].decode()) if own is None else [own], np.uint32)
            size[k] = len(ids)
            parts.append(ids)
        flat = np.concatenate(parts)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), np.uint32)))
        self.pool[self.used : self.used + len(flat)] = flat
        asked = np.array(plain + odd, np.int64)
        at = np.zeros(len(texts), np.int64)
        at[asked] = self.used + np.cumsum(size[asked]) - size[asked]
        slots = np.arange(len(keys)) + len(self.at)
        self.at, self.size = np.concatenate((self.at, at)), np.concatenate((self.size, size))
        self.used += len(flat)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, place, keys), np.insert(self.slots, place, slots)

    def marks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First byte and end of each added token (the leftmost, and of those the longest) within a row."""
        blob = data.tobytes() if self.added else b""
        if not any(t in blob for t in self.added):
            return np.zeros((0, 2), np.int64)
        spans = [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.mark.finditer(blob, a, b)]
        return np.array(spans, np.int64).reshape(-1, 2)

    def encode(self, column: pa.Array):
        """Yields (row, ids)."""
        for lo, hi, data, offsets in pieces(column, 1 << 20):
            if len(self.keys) > CACHED_STRETCHES:
                self.forget()
            marks = self.marks(data, offsets)
            # an added token is one stretch, and the texts beside it are encoded like texts of their own
            start = stretch_starts(data, np.unique(np.concatenate((offsets, marks.ravel()))) if len(marks) else offsets)
            for a, b in marks.tolist():
                start[a + 1 : b] = False
            hashes, at = run_hashes(data, np.ones(len(data), bool), start)
            keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            slot = self.find(keys)
            missing = np.flatnonzero(slot < 0)
            if len(missing):
                end = np.append(at[1:], len(data))
                blob = data.tobytes()
                self.learn(keys[missing], [blob[a:b] for a, b in zip(at[first[missing]].tolist(), end[first[missing]].tolist(), strict=True)])
                slot = self.find(keys)
            own = slot[inverse]
            size = self.size[own]
            upto = np.concatenate(([0], np.cumsum(size)))
            ids = self.pool[np.repeat(self.at[own] - upto[:-1], size) + np.arange(upto[-1])]
            rows = upto[np.searchsorted(at, offsets)]
            for row in range(lo, hi):
                yield row, ids[rows[row - lo] : rows[row - lo + 1]]
