"""Deterministic automata for byte-pair encoding.

Two layers:

* ``TokenAutomaton`` reads *tokens* and accepts exactly the token sequences that BPE makes. It is built by one merge
  gadget per merge, in merge order. Before any merge there is one state, which allows every symbol. The gadget of the
  merge ``a b -> c`` (a) gives ``c`` the state that ``b`` leads to at this moment and (b) copies the state that ``a``
  leads to, without its arc ``b``. A state reached by token ``t`` so is "the state of t's right part as it was when t
  was made, less the arcs that merges of t took away since", which is what is stored: a dict of removed arcs with
  their time, a link to the older state and the time at which it was copied. An arc ``x`` of a state exists if neither
  ``x`` nor the left part from which it was made had been removed when it was made.
* ``SymbolTransducer`` reads *symbols* (bytes; for vocabularies with word ends the last byte of a word is another
  symbol). Every prefix of a word has one accepted token sequence, so that a state is the set of token beginnings that
  end here, each with the last token before it and the token count there, relative to now. Its arcs are compiled when
  first needed, kept in a table, and annotated with the number of emitted tokens (the change of the prefix's token
  count, which can be negative) and with the last token of the prefix, from which the tokens are read backwards.

Words of no bytes have no tokens; there are no nulls at this level.
"""

from __future__ import annotations

import json
from array import array

import numpy as np

ROOT = 0
#: States and answers about arcs that a worker keeps; when full, they are made anew. A state takes some 200 bytes, an answer some 100.
STATES_KEPT, ARCS_KEPT = 200_000, 200_000


def byte_symbols() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies: itself where printable, else the next free one from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and tokens as numbers; symbols 0..255 are bytes and 256..511 bytes that end a word, if the vocabulary has those."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.spec = {k: v for k, v in spec.items() if k != "model"}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.names = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        chars = byte_symbols()
        byte_of = {c: b for b, c in chars.items()}
        self.symbol_token = {b: vocab[c] for b, c in chars.items()}
        if self.suffix:
            self.symbol_token |= {256 + b: vocab[c + self.suffix] for b, c in chars.items()}
        self.merges: list[tuple[int, int, int]] = []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
        self.symbols: dict[int, tuple[int, ...]] = {}
        for i, s in self.names.items():
            ends = bool(self.suffix) and s.endswith(self.suffix) and len(s) > len(self.suffix)
            body = s[: -len(self.suffix)] if ends else s
            if all(c in byte_of for c in body):
                got = [byte_of[c] for c in body]
                if ends:
                    got[-1] += 256
                self.symbols[i] = tuple(got)


class TokenAutomaton:
    """The automaton over tokens; ``allows(t, x)`` tells whether the state that ``t`` leads to has an arc ``x``."""

    def __init__(self, vocab: Vocabulary):
        self.made: dict[int, int] = {}  # token -> when its merge came
        self.left: dict[int, int] = {}
        self.older: dict[int, int] = {}  # token -> the token whose state its own was copied from
        self.removed: dict[int, dict[int, int]] = {}  # token -> removed arcs of its state, with their time
        for time, (a, b, c) in enumerate(vocab.merges):
            if c in self.made:
                continue
            self.made[c], self.left[c], self.older[c] = time, a, b
            self.removed.setdefault(a, {}).setdefault(b, time)
        self._known: dict[int, bool] = {}

    def allows(self, t: int, x: int) -> bool:
        if t < 0:
            return True
        key = t << 24 | x
        known = self._known.get(key)
        if known is None:
            if len(self._known) > ARCS_KEPT:
                self._known.clear()
            known = self._known[key] = self._arc(t, x)
        return known

    def _arc(self, t: int, x: int) -> bool:
        # the arcs from which x came, each with the time at which the next one was made from it
        came, until = [], float("inf")
        while True:
            came.append((x, until))
            if x not in self.left:
                break
            x, until = self.left[x], self.made[x]
        state, copied = t, float("inf")
        while state is not None:
            gone = self.removed.get(state)
            if gone:
                for arc, until in came:
                    time = gone.get(arc)
                    # of two equal merges the left one comes first, hence "at the latest" to the right
                    if time is not None and time < copied and time <= until:
                        return False
            copied, state = self.made.get(state, 0), self.older.get(state)
        return True


class SymbolTransducer:
    """Table-driven encoder and token counter for many words at a time.

    A beginning that can go on is kept in a state's key as one integer: its place in the token trie, the token before it
    plus one, and the token count before it relative to now. A key is the bytes of these, of the last token and of the count emitted. Arcs lie in an open hash table of arrays, so that all words
    take a step at once; those met for the first time are compiled. The table is emptied at ``max_states``.
    """

    def __init__(self, vocab: Vocabulary, max_states: int = STATES_KEPT):
        self.tokens, self.max_states, self.end = TokenAutomaton(vocab), max_states, 256 if vocab.suffix else 0
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        made = {c for _, _, c in vocab.merges} | set(vocab.symbol_token.values())
        for i in sorted(made):
            node = ROOT
            for s in vocab.symbols[i]:
                nxt = self.child.get(node << 9 | s)
                if nxt is None:
                    nxt = self.child[node << 9 | s] = len(self.token_at)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.goes_on = {k >> 9 for k in self.child}
        self.length = np.zeros(max(made) + 1, np.int64)
        for i in made:
            self.length[i] = len(vocab.symbols[i])
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.last, self.emits = np.empty(1024, np.int32), np.empty(1024, np.int64)
        self.arcs, self.arc_from, self.arc_to = 0, np.full(1 << 14, -1, np.int64), np.empty(1 << 14, np.int32)
        self.state((self.packed(ROOT, -1, 0),), -1, 0)  # number 0, where words begin

    @staticmethod
    def packed(node: int, before: int, n: int) -> int:
        return node << 40 | (before + 1) << 16 | (n + 32768)

    def state(self, key: tuple, last: int, emits: int) -> int:
        # the annotations are of the arc into the state, so they tell states apart, too
        packed = array("q", (*key, last, emits)).tobytes()
        got = self.numbers.get(packed)
        if got is None:
            got = self.numbers[packed] = len(self.keys)
            self.keys.append(packed)
            if got == len(self.last):
                self.last, self.emits = np.resize(self.last, 2 * got), np.resize(self.emits, 2 * got)
            self.last[got], self.emits[got] = last, emits
        return got

    def compiled(self, state: int, symbol: int) -> int:
        last, count, still = -1, 0, []
        for entry in array("q", self.keys[state])[:-2]:
            node, before, n = entry >> 40, (entry >> 16 & 0xFFFFFF) - 1, (entry & 0xFFFF) - 32768
            nxt = self.child.get(node << 9 | symbol)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if last < 0 and token >= 0 and self.tokens.allows(before, token):
                last, count = token, n + 1
            if nxt in self.goes_on:
                still.append((nxt, before, n))
        if last < 0:
            raise ValueError(f"no token for symbol {symbol}")
        key = (*(self.packed(node, before, n - count) for node, before, n in still), self.packed(ROOT, last, 0))
        return self.state(key, last, count)

    def slots(self, arcs: np.ndarray) -> np.ndarray:
        bits = len(self.arc_from).bit_length() - 1
        return (arcs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def found(self, arcs: np.ndarray) -> np.ndarray:
        """Slot of each arc, or the free one where its search ends."""
        slot, mask = self.slots(arcs), len(self.arc_from) - 1
        there = self.arc_from[slot]
        on = np.flatnonzero((there != arcs) & (there >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & mask
            there = self.arc_from[slot[on]]
            on = on[(there != arcs[on]) & (there >= 0)]
        return slot

    def add(self, arcs: np.ndarray, to: np.ndarray) -> None:
        """Put new arcs, each once, into the table."""
        if 2 * (self.arcs + len(arcs)) > len(self.arc_from):
            size = 1 << (2 * (self.arcs + len(arcs))).bit_length()
            old = self.arc_from >= 0
            arcs, to = np.concatenate([self.arc_from[old], arcs]), np.concatenate([self.arc_to[old], to])
            self.arcs, self.arc_from, self.arc_to = 0, np.full(size, -1, np.int64), np.empty(size, np.int32)
        self.arcs += len(arcs)
        while len(arcs):  # of arcs that find the same free slot, the last gets it and the others go on
            slot = self.found(arcs)
            self.arc_from[slot], self.arc_to[slot] = arcs, to
            left = self.arc_from[slot] != arcs
            arcs, to = arcs[left], to[left]

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        arcs = states.astype(np.int64) << 9 | symbols
        slot = self.found(arcs)
        missing = self.arc_from[slot] != arcs
        if missing.any():
            new = np.unique(arcs[missing])
            self.add(new, np.array([self.compiled(arc >> 9, arc & 511) for arc in new.tolist()], np.int32))
            slot = self.found(arcs)
        return self.arc_to[slot]

    def walk(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Steps of all words together: which words took one, the place of its byte and the states. Lengths are at least 1."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        least, states = -lengths, np.zeros(len(order), np.int32)
        for k in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(least, -k))  # words with more than k bytes
            at = starts[:n] + k
            states = self.step(states[:n], data[at] + np.where(lengths[:n] == k + 1, self.end, 0))
            yield order[:n], at, states

    def walk_alone(self, data: np.ndarray, start: int, length: int) -> np.ndarray:
        """The states of one long word."""
        arcs: dict[int, int] = {}
        state, path = 0, np.empty(length, np.int32)
        for k, symbol in enumerate(data[start : start + length].tolist()):
            arc = state << 9 | (symbol + self.end if k == length - 1 else symbol)
            state = arcs.get(arc)
            if state is None:
                state = arcs[arc] = int(self.step(np.array([arc >> 9]), np.array([arc & 511]))[0])
            path[k] = state
        return path

    def groups(self, lengths: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Words that go together, and long ones, in which numpy's cost of a step would count for each byte."""
        if len(self.keys) > self.max_states:
            self.reset()
        return np.flatnonzero((lengths > 0) & (lengths <= 64)), np.flatnonzero(lengths > 64).tolist()

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of tokens of each word, the bytes between two offsets: the sum of the annotations of its arcs."""
        lengths, data = np.diff(offsets), data.astype(np.int64)
        total = np.zeros(len(lengths), np.int64)
        together, alone = self.groups(lengths)
        for which, _, states in self.walk(data, offsets[together], lengths[together]):
            total[together[which]] += self.emits[states]
        for i in alone:
            total[i] = self.emits[self.walk_alone(data, int(offsets[i]), int(lengths[i]))].sum()
        return total

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after another, and the number of each word's."""
        lengths, data = np.diff(offsets), data.astype(np.int64)
        last, ends = np.zeros(len(data), np.int64), np.zeros(len(data) + 1, bool)
        together, alone = self.groups(lengths)
        for _, at, states in self.walk(data, offsets[together], lengths[together]):
            last[at] = self.last[states]
        # backwards from the last token of each word to the one before it
        begin, at = offsets[together], offsets[together] + lengths[together]
        while len(at):
            ends[at - 1] = True
            at = at - self.length[last[at - 1]]
            more = at > begin
            begin, at = begin[more], at[more]
        for i in alone:
            start, at = int(offsets[i]), int(offsets[i] + lengths[i])
            path = self.last[self.walk_alone(data, start, at - start)]
            last[start:at] = path
            while at > start:
                ends[at - 1] = True
                at -= int(self.length[path[at - 1 - start]])
        upto = np.concatenate([[0], np.cumsum(ends[:-1])])
        return last[ends[:-1]], np.diff(upto[offsets])
