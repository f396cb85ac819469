"""A tokenization automaton for byte-level BPE.

The automaton's arcs are labelled with tokens; a path from the start spells a byte string and its labels are the string's
BPE tokens. It starts with one state and a loop for every byte. Each merge (u, v) -> t, in order, adds one gadget: after u
the arc v is cut, and wherever an arc u leads to such a state an arc t is added that ends where v ended. All arcs with one
label end in states that behave alike, so the finished automaton has one state a token, besides the start. Written out, its
table of 50,000 states and tokens would have billions of cells; but whether an arc is there follows from the gadgets of the
two tokens it joins, so the gadgets are kept as arrays (birth, parts, cut) and a state's row of the table is filled, cell by
cell, when a text first reaches it. Encoding walks a word forward from state to state: every place that a token can end at is
reached by exactly one arc, since a byte string has one path only. Decoding concatenates the labels.
"""

from __future__ import annotations

import base64
import json

#: The start's state; the state that token t leads to is t + 1.
START = 0
#: Identifiers of tokens are smaller than this.
LARGEST = 1 << 20


class MergeAutomaton:
    def __init__(self) -> None:
        self.label: dict[int, bytes] = {}
        self.ident: dict[bytes, int] = {}
        # gadgets, by token: when it was born (0: a byte) and of which parts; by pair of tokens: when their arc was cut
        self.birth: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.cut: dict[int, int] = {}
        #: The table: row of each state that was reached, token to whether the state has its arc.
        self.rows: dict[int, dict[int, bool]] = {}
        # labels as a trie: (node, byte) to node, and the token that ends there
        self.next: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.nodes = 1

    # construction

    def add_byte(self, ident: int, byte: bytes) -> None:
        self._add(ident, byte, 0)

    def add_merge(self, ident: int, u: int, v: int, time: int) -> None:
        """The gadget of one merge; times rise from 1."""
        self._add(ident, self.label[u] + self.label[v], time)
        self.left[ident], self.right[ident] = u, v
        self.cut.setdefault(u * LARGEST + v, time)

    def _add(self, ident: int, label: bytes, time: int) -> None:
        if not 0 <= ident < LARGEST:
            raise ValueError("token identifier out of range")
        self.label[ident] = label
        self.ident[label] = ident
        self.birth[ident] = time
        node = 0
        for byte in label:
            key = node << 8 | byte
            if key not in self.next:
                self.next[key] = self.nodes
                self.nodes += 1
            node = self.next[key]
        self.ends[node] = ident

    # transitions

    def arc(self, state: int, token: int) -> bool:
        """Whether the finished automaton has an arc of this token out of a state."""
        row = self.rows.setdefault(state, {})
        found = row.get(token)
        if found is None:
            found = row[token] = state == START or self._joined(state - 1, token)
        return found

    def _joined(self, p: int, t: int) -> bool:
        """Whether arc t is left after token p, told by going back through the gadgets, the younger of the two first."""
        birth, cut, time = self.birth, self.cut, 1 << 60
        while cut.get(p * LARGEST + t, time + 1) > time:
            born_p, born_t = birth[p], birth[t]
            if not born_p and not born_t:
                return True
            if born_p > born_t:  # the state after p was the state after its right part, just before p was born
                p, time = self.right[p], born_p - 1
            else:  # the arc t was drawn where the arc of its left part was left over
                t, time = self.left[t], born_t
        return False

    def forget(self) -> None:
        """Empties the table; gadgets stay."""
        self.rows.clear()

    # encoding and decoding

    def encode(self, word: bytes) -> list[int]:
        whole = self.ident.get(word)
        if whole is not None:
            return [whole]  # one arc from the start is a path, and there is only one
        step, ends, n = self.next.get, self.ends.get, len(word)
        state = [-1] * (n + 1)
        state[0] = START
        for at in range(n):
            here = state[at]
            if here < 0:
                raise ValueError("a byte of the text is not in the vocabulary")
            row = self.rows.get(here)
            if row is None:
                row = self.rows[here] = {}
            node, end = 0, at
            while end < n:
                node = step(node << 8 | word[end])
                if node is None:
                    break
                end += 1
                if state[end] < 0:
                    token = ends(node)
                    if token is not None:
                        there = row.get(token)
                        if there is None:
                            there = self.arc(here, token)
                        if there:
                            state[end] = token + 1
        if n and state[n] < 0:
            raise ValueError("a byte of the text is not in the vocabulary")
        out = []
        while n:
            out.append(state[n] - 1)
            n -= len(self.label[state[n] - 1])
        out.reverse()
        return out

    def decode(self, idents: list[int]) -> bytes:
        return b"".join(self.label[i] for i in idents)

    # vocabularies

    @classmethod
    def from_ranks(cls, text: bytes) -> MergeAutomaton:
        """From a rank file (base64 token and rank a line); the automaton so far tells the two parts of the next token."""
        auto = cls()
        ranks = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in text.splitlines() if line.strip()))
        for rank, token in ranks:
            if len(token) == 1:
                auto.add_byte(rank, token)
        for time, (rank, token) in enumerate(((r, t) for r, t in ranks if len(t) > 1), 1):
            parts = auto.encode(token)
            auto.forget()
            if len(parts) != 2:
                raise ValueError(f"token {rank} is not a merge of two earlier tokens")
            auto.add_merge(rank, *parts, time)
        return auto

    @classmethod
    def from_merges(cls, text: bytes) -> MergeAutomaton:
        """From a tokenizer file in JSON with byte-level vocabulary and merges; special tokens are left out."""
        model = json.loads(text)["model"]
        byte_of = {c: b for b, c in byte_symbols().items()}
        auto = cls()
        vocab = model["vocab"]
        for symbol, byte in byte_of.items():
            auto.add_byte(vocab[symbol], bytes([byte]))
        for time, pair in enumerate(model["merges"], 1):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            auto.add_merge(vocab[u + v], vocab[u], vocab[v], time)
        return auto


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabulary files: itself if printable Latin-1, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
