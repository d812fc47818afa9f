"""A lexicon as a trie, intersected with Levenshtein automata.

Terms are whole words, or stems that any word may begin with. The product of the
trie with the automaton for one edit is determinised lazily: a state is the set
of (trie node, edits) that a word read so far may have reached, and transitions
are filled in as words need them. Words are then run through it together, one
character of all of them at a time.
"""

from __future__ import annotations

import numpy as np

#: Terms shorter than this match exactly only.
FUZZY_LENGTH = 5


class Matcher:
    """terms: (word, is a stem). match() gives each word's best term and its edits."""

    def __init__(self, terms: list[tuple[str, bool]], edits: int = 1):
        self.terms, self.edits = terms, edits
        self.children: list[dict[str, int]] = [{}]
        self.word_end: list[int] = [-1]  # number of the whole word that ends at a node
        self.stem_end: list[int] = [-1]
        self.reach: list[int] = [0]  # length of the longest term below a node
        for number, (term, is_stem) in enumerate(terms):
            node = 0
            self.reach[0] = max(self.reach[0], len(term))
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word_end.append(-1)
                    self.stem_end.append(-1)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], len(term))
            (self.stem_end if is_stem else self.word_end)[node] = number
        letters = sorted({c for term, _ in terms for c in term})
        self.letter = {c: i + 1 for i, c in enumerate(letters)}  # 0 is every other character
        self.letters = ["", *letters]
        self.sets: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.table = np.zeros((0, len(self.letters)), np.int32)
        self.final = np.zeros((0, 4), np.int32)  # term and edits if the word ends here; term and edits of a stem read
        self._number(frozenset())  # 0: nothing can match
        self.first = self._number(self._closed({(0, 0)}))

    def _closed(self, pairs: set) -> frozenset:
        """With the pairs that are reached by leaving out letters of the term; of a node only the least edits stay."""
        best: dict[int, int] = {}
        left = list(pairs)
        while left:
            node, e = left.pop()
            if best.get(node, self.edits + 1) <= e:
                continue
            best[node] = e
            if e < self.edits:
                left += [(child, e + 1) for child in self.children[node].values() if self.reach[child] >= FUZZY_LENGTH]
        return frozenset(best.items())

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.sets)
            self.sets.append(state)
            if len(self.sets) > len(self.table):
                more = max(1024, len(self.table))
                self.table = np.concatenate([self.table, np.full((more, len(self.letters)), -1, np.int32)])
                self.final = np.concatenate([self.final, np.full((more, 4), -1, np.int32)])
            row = self.final[len(self.sets) - 1]
            for at, ends in ((0, self.word_end), (2, self.stem_end)):
                hits = [(e, ends[node]) for node, e in state if ends[node] >= 0 and (not e or len(self.terms[ends[node]][0]) >= FUZZY_LENGTH)]
                if hits:
                    e, term = min(hits)
                    row[at : at + 2] = term, e
        return self.numbers[state]

    def _next(self, state: int, letter: int) -> int:
        c, out = self.letters[letter], set()
        for node, e in self.sets[state]:
            for child_letter, child in self.children[node].items():
                if child_letter == c:
                    out.add((child, e))
                elif e < self.edits and self.reach[child] >= FUZZY_LENGTH:
                    out.add((child, e + 1))
            if e < self.edits and self.reach[node] >= FUZZY_LENGTH:
                out.add((node, e + 1))
        return self._number(self._closed(out))

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the number of its best term, -1 if none, and the edits."""
        n = len(words)
        term, edits = np.full(n, -1, np.int64), np.full(n, self.edits + 1, np.int64)
        if not n or not self.terms:
            return term, edits
        size = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        known = np.zeros(max(int(codes.max(initial=0)), *map(ord, self.letter)) + 1, np.int32)
        for c, i in self.letter.items():
            known[ord(c)] = i
        codes = known[codes]
        start = np.cumsum(size) - size
        live = np.flatnonzero(size > 0)
        state = np.full(len(live), self.first, np.int64)
        step = 0
        while len(live):
            letter = codes[start[live] + step]
            then = self.table[state, letter]
            if (then < 0).any():
                new = np.unique(state[then < 0] * len(self.letters) + letter[then < 0])
                for s, c in zip(*(x.tolist() for x in np.divmod(new, len(self.letters)))):
                    to = self._next(s, c)  # may put a larger table in place
                    self.table[s, c] = to
                then = self.table[state, letter]
            state = then.astype(np.int64)
            step += 1
            row = self.final[state]
            for at, here in ((2, row[:, 2] >= 0), (0, (row[:, 0] >= 0) & (size[live] == step))):
                better = here & (row[:, at + 1] < edits[live])
                term[live[better]], edits[live[better]] = row[better, at], row[better, at + 1]
            keep = (state > 0) & (size[live] > step) & (edits[live] > 0)
            live, state = live[keep], state[keep]
        edits[term < 0] = 0
        return term, edits
