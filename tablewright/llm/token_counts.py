"""Counts of greedy word pieces by a linear longest-match automaton.

The vocabulary is a trie over bytes. Each node has a failure link and the number of pieces that leave the front of
the word when the link is followed, so a word is counted in one pass over its bytes and no piece is ever built. At a
node that is itself a piece, that piece leaves and matching goes on at the root; else the longest piece on the node's
path leaves, and what remains of the path is matched anew, which the link and its count hold beforehand.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import full_text

#: Fixed value: how text is cut into words before the vocabulary is matched (after lower-casing).
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"""
#: Byte value after a word's last byte, so that pieces for word ends match only there.
END = 256
#: Distinct words a task remembers before it starts afresh.
REMEMBERED = 400_000


def byte_letters() -> dict[str, int]:
    """The public byte-to-letter rule of byte-level vocabularies: printable bytes stand for themselves, the rest
    follow from code point 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def load_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level tokenizer file as byte values; `</w>` becomes END. Special tokens are left out."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    special = {t["content"] for t in data.get("added_tokens", []) if t.get("special")}
    letters, pieces = byte_letters(), []
    for piece in data["model"]["vocab"]:
        if piece in special:
            continue
        stem, end = (piece[:-4], (END,)) if piece.endswith("</w>") else (piece, ())
        if all(c in letters for c in stem):
            pieces.append(tuple(letters[c] for c in stem) + end)
    return [p for p in pieces if p]


class Automaton:
    """Trie with failure links; next[node] maps a byte to a child, pops[node] pieces leave along fail[node]."""

    def __init__(self, pieces: list[tuple[int, ...]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                child = self.next[node].get(byte)
                if child is None:
                    child = len(self.next)
                    self.next[node][byte] = child
                    self.next.append({})
                    final.append(False)
                node = child
            final[node] = True
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in self.next[parent].items():
                queue.append(node)
                if final[node]:
                    self.fail[node], self.pops[node] = 0, 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while at >= 0 and byte not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.pops[node] = self.next[at][byte], popped

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of a word; 1 (unknown) where no piece fits somewhere."""
        follow, fail, pops = self.next, self.fail, self.pops
        node = total = 0
        for byte in (*word, END):
            child = follow[node].get(byte)
            while child is None:
                if fail[node] < 0:
                    # the end mark alone may stay unmatched: the vocabulary has no piece for word ends
                    return total if byte == END and node == 0 and total else 1
                total += pops[node]
                node = fail[node]
                child = follow[node].get(byte)
            node = child
        while node:
            if fail[node] < 0:
                return 1
            total += pops[node]
            node = fail[node]
        return total


class _Counts(dict):
    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = self.automaton.count(word.encode())
        return n


def _count(automaton, pattern: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, cut = _Counts(automaton.value), regex.compile(pattern)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column("text").to_pylist():
                found = cut.findall(text.lower())
                n_words.append(len(found))
                n_tokens.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()),
                                              pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])
    return count


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 pattern: str = WORD) -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens (greedy pieces of all words of the lower-cased text).

    vocabulary: path of the tokenizer file, read on the driver; the automaton is broadcast (its size is that of the
    vocabulary). NULL text has no words. Ids are not looked at: NULL and repeated ids keep their rows. An empty table
    gives no rows; other columns are left out.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(load_vocabulary(vocabulary)))
    rows = docs.select(F.col(id_col).alias("doc_id"), full_text(F.col(text_col)).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_count(automaton, pattern), f"doc_id {id_type}, n_words long, n_tokens long")
