"""Greedy longest-match piece counts by a linear-time automaton: a vocabulary trie with failure links.

A state is a trie node: the longest prefix of the text not yet cut off that is in the trie. Where a byte has
no edge, the greedy pieces of the state's string are popped and the rest of the string is another node: the
failure link, stored with the number of popped pieces. So a word is counted without building its pieces.
"""

from __future__ import annotations

import base64
from collections import ChainMap

import numpy as np
from pyspark.sql import DataFrame

from .common import map_slices

#: Words remembered by a worker before it starts anew, and the bytes of the longest of them.
REMEMBERED, LONGEST = 1_000_000, 64


class Automaton:
    """Over byte strings; every single byte must be a piece, so each string has a greedy cut. A vocabulary that lacks one is an error,
    but for bytes that the `alphabet` of the texts leaves out."""

    def __init__(self, pieces: list[bytes], alphabet: bytes = bytes(range(256))) -> None:
        if lacking := set(alphabet) - {p[0] for p in pieces if len(p) == 1}:
            raise ValueError(f"the vocabulary has no piece for {len(lacking)} single bytes, the first {min(lacking)}")
        edges: dict[tuple[int, int], int] = {}
        ends, parent, depth = [False], [(0, 0)], [0]
        for piece in sorted(pieces):
            at = 0
            for b in piece:
                if (at, b) not in edges:
                    edges[at, b] = len(ends)
                    ends.append(False)
                    parent.append((at, b))
                    depth.append(depth[at] + 1)
                at = edges[at, b]
            ends[at] = bool(piece)
        n = len(ends)
        fail, popped = [-1] * n, [0] * n
        for v in np.argsort(np.array(depth), kind="stable")[1:].tolist():  # a link needs those of shorter strings
            u, b = parent[v]
            if ends[v]:  # the whole string is one piece
                fail[v], popped[v] = 0, 1
                continue
            at, count = fail[u], popped[u]  # u's pieces go first, then go on from the rest
            while at != -1 and (at, b) not in edges:
                count += popped[at]
                at = fail[at]
            if at != -1:
                fail[v], popped[v] = edges[at, b], count
        self.edges = {(u << 8) | b: v for (u, b), v in edges.items()}
        keys = np.array(list(self.edges), "i8")
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(self.edges.values()), "i8")[order]
        self.first = np.full(256, -1, "i8")
        for (u, b), v in edges.items():
            if u == 0:
                self.first[b] = v
        self.lists, self.fail, self.popped = (fail, popped), np.array(fail, "i8"), np.array(popped, "i8")

    def go(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The edges' ends, -1 where there are none."""
        key = (state << 8) | byte
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(state == 0, self.first[byte], np.where(self.keys[k] == key, self.to[k], -1))

    def count(self, word: bytes) -> int:
        """Number of greedy pieces of one word, byte by byte: for long words, which would advance alone."""
        edges, (fail, popped) = self.edges, self.lists
        state = total = 0
        for b in word:
            while (to := edges.get(state << 8 | b)) is None:
                total += popped[state]
                state = fail[state]
            state = to
        while state > 0:
            total += popped[state]
            state = fail[state]
        return total

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of greedy pieces of each word; all words advance together, byte by byte."""
        lengths = np.array([len(w) for w in words], "i8")
        order = np.argsort(-lengths, kind="stable")
        data, starts = np.frombuffer(b"".join(words), "u1").astype("i8"), np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        left, state, total = lengths[order], np.zeros(len(words), "i8"), np.zeros(len(words), "i8")
        for at in range(int(left[0]) if len(words) else 0):
            n = int(np.searchsorted(-left, -at, "left"))  # words longer than at
            byte, todo = data[starts[:n] + at], np.arange(n)
            while len(todo):
                to = self.go(state[todo], byte[todo])
                state[todo[to >= 0]] = to[to >= 0]
                todo = todo[to < 0]
                total[todo] += self.popped[state[todo]]
                state[todo] = self.fail[state[todo]]
        while (todo := np.flatnonzero(state > 0)).size:  # what is left at the ends
            total[todo] += self.popped[state[todo]]
            state[todo] = self.fail[state[todo]]
        out = np.empty(len(words), "i8")
        out[order] = total
        return out


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a rank file: a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


_kept: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def kept(path: str) -> tuple[Automaton, dict[bytes, int]]:
    if path not in _kept:
        _kept[path] = Automaton(read_pieces(path)), {}
    return _kept[path]


def count_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of whole texts: each word, with a space before it, is cut greedily.

    Words are what ASCII white space separates. Null and empty texts have no words and no tokens; repeated
    rows are counted each; null doc_ids stay; an empty table gives no rows; extra columns are ignored.
    """

    def count(rows) -> dict:
        automaton, known = kept(path)
        words = [(t or "").encode().split() for t in rows["text"].to_pylist()]
        if len(known) > REMEMBERED:
            known.clear()
        new = set().union(*words).difference(known)
        long = {w: automaton.count(b" " + w) for w in new if len(w) > LONGEST}
        if new := list(new.difference(long)):
            known.update(zip(new, automaton.counts([b" " + w for w in new]).tolist(), strict=True))
        of = ChainMap(known, long).__getitem__ if long else known.__getitem__
        return {"doc_id": rows["doc_id"], "n_words": [len(w) for w in words], "n_tokens": [sum(map(of, w)) for w in words]}

    return map_slices(docs.select("doc_id", "text"), count, "doc_id long, n_words long, n_tokens long")
