"""Byte-level BPE by a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over tokens that accepts exactly the correct
tokenizations (Berglund, Martens and van der Merwe, 2024). It starts as one state with a loop for every byte. The
gadget of a merge ``u v -> w``, where ``p`` is the state that ``u`` leads to: a copy of ``p`` without the arc ``v``
becomes the new target of ``u``, and every state with an arc ``u`` gets an arc ``w`` to where ``v`` leads. All arcs
of a label lead to one state, so the automaton is kept as a target for each label and, for each state, its origin and
the one arc that its copy lost: that is enough to tell the arcs of any state, and a table of the answers given so far
makes the lookup of a transition one step.

A pre-split word is encoded by following the arcs whose labels spell it, longest first: every prefix of a word has exactly one
correct tokenization, so one path at most leads to each position. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

# The word pattern of the public byte-level BPE and its special token.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_BYTES = 24 << 20
ENTRY_BYTES = 260  # of a word's string, its array and its place in the table, without their contents
TABLE_CACHE = 250_000
LOSS_CACHE = 200_000
FLUSH_TOKENS = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """The automaton of a vocabulary: ``encode_word`` and ``decode`` work on bytes."""

    def __init__(self, labels: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.special = special or {}
        self.labels = {i: b for b, i in labels.items()} | {i: s.encode() for s, i in self.special.items()}
        self.target = dict.fromkeys(labels.values(), 0)
        self.origin, self.lost, self.born = [-1], [-1], [-1]
        self.left: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        for m, (u, v) in enumerate(merges):
            self._gadget(m, labels[u], labels[v], labels[u + v])
        self.losses: dict[int, dict[int, int]] = {}
        self.losses_held = 0
        self.live = {i for b, i in labels.items() if len(b) == 1} | set(self.made)
        self.whole = {b: i for b, i in labels.items() if i in self.live}  # the start state has every live label
        self.next: dict[int, int] = {}  # of the trie of live labels: node and byte to node
        self.spelt = array("i", [-1])  # the label that ends in a node
        for b, i in self.whole.items():
            node = 0
            for x in b:
                node = self.next.setdefault(node << 8 | x, len(self.spelt))
                if node == len(self.spelt):
                    self.spelt.append(-1)
            self.spelt[node] = i

    def _gadget(self, m: int, u: int, v: int, w: int) -> None:
        if w in self.made or not self._arc(self.target[u], v):
            return  # v never follows u, so the merge never happens
        self.left[w], self.made[w] = u, m
        self.target[w] = self.target[v]
        self.origin.append(self.target[u])
        self.lost.append(v)
        self.born.append(m)
        self.target[u] = len(self.origin) - 1

    def _arc(self, state: int, label: int) -> bool:
        """Whether ``state`` has an arc ``label``: a label younger than the state came with its left part; an older one came from the state's origin."""
        while state:
            made = self.made.get(label, -1)
            if made >= self.born[state]:
                label = self.left[label]
            elif self.lost[state] == label:
                return False
            else:
                state = self.origin[state]
        return True

    def lost_on_the_way(self, state: int) -> dict[int, int]:
        """The labels that a state and its origins have lost, and when; told once for each state in use."""
        found = self.losses.get(state)
        if found is None:
            found, at = {}, state
            while at:
                found[self.lost[at]] = self.born[at]
                at = self.origin[at]
            if self.losses_held >= LOSS_CACHE:
                self.losses.clear()
                self.losses_held = 0
            self.losses[state] = found
            self.losses_held += len(found)
        return found

    def arc(self, state: int, label: int) -> bool:
        """As ``_arc``, down the left parts of the label: one that the state lost while it was still the newest counts."""
        losses, limit = self.lost_on_the_way(state), len(self.made) + 10**9
        while label is not None:
            lost = losses.get(label)
            if lost is not None and lost <= limit:
                return False
            limit = self.made.get(label, -1)
            label = self.left.get(label)
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the only path that spells ``word``.

        Of the arcs that leave a position the longest is tried first. A position is reached by one path at most, so going
        back where none leads on visits no position twice.
        """
        label = self.whole.get(word)
        if label is not None:
            return [label]
        step, spelt, target, table, n = self.next.get, self.spelt, self.target, self.table, len(word)
        path: list[int] = []
        left: list[tuple[int, list[tuple[int, int]]]] = []  # the state of each position on the path, and the shorter arcs not yet tried
        at = state = 0
        while at < n:
            node, arcs = 0, []
            for j in range(at, n):
                node = step(node << 8 | word[j])
                if node is None:
                    break
                label = spelt[node]
                if label >= 0:
                    arcs.append((j + 1, label))
            while True:
                if not arcs:
                    path.pop()
                    state, arcs = left.pop()
                    continue
                at, label = arcs.pop()
                key = state << 20 | label
                ok = table.get(key)
                if ok is None:
                    if len(table) >= TABLE_CACHE:
                        table.clear()
                    ok = table[key] = self.arc(state, label)
                if ok:
                    break
            left.append((state, arcs))
            path.append(label)
            state = target[label]
        return path

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class Memory(dict):
    """What is known of each word, in two generations of at most ``CACHE_BYTES`` each; ``make`` tells what isn't."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= 64:
            if self.held >= CACHE_BYTES:
                self.old, self.held = {}, 0  # the generation before goes first
                self.old.update(self)
                self.clear()
            self[word] = found
            self.held += ENTRY_BYTES + 2 * len(word) + 4 * len(found)
        return found

    def forget(self) -> None:
        self.clear()
        self.old, self.held = {}, 0


class Codec:
    """Splits texts into words, encodes them through the automaton with a bounded memory of words, and decodes."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        back = byte_alphabet()
        as_bytes = lambda s: bytes(back[c] for c in s)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        labels = {as_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        merges = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.automaton = TokenAutomaton(labels, merges, special)
        self.words = regex.compile(WORD_PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.known = Memory(self._word)

    def _word(self, word: str) -> array:
        return array("i", self.automaton.encode_word(word.encode()))

    def encode(self, text: str) -> array:
        """The ids of the whole text, four bytes each."""
        out = array("i")
        if self.cut is None or not any(s in text for s in self.automaton.special):
            for ids in map(self.known.__getitem__, self.words.findall(text)):
                out += ids
            return out
        for part in self.cut.split(text):
            i = self.automaton.special.get(part)
            if i is not None:
                out.append(i)
            else:
                for ids in map(self.known.__getitem__, self.words.findall(part)):
                    out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return self.automaton.decode(ids).decode("utf-8", errors="replace")

    def forget(self) -> None:
        """Gives the memory of words and transitions back; the automaton stays."""
        self.known.forget()
        self.automaton.table.clear()
        self.automaton.losses.clear()
        self.automaton.losses_held = 0


def codec(content: bytes) -> Codec:
    """The codec of a vocabulary file's content, compiled once in a worker."""
    return common.kept(("codec", hashlib.sha256(content).digest()), lambda: Codec(content))


def vocabulary(path: str) -> bytes:
    """The content of a vocabulary file, read where the driver runs."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded (the text that the ids spell) for each row.

    Null texts count as empty and have no ids; repeated rows repeat; other columns are ignored; empty tables give none.
    """
    return _run(docs, path, id_col, text_col, whole=True)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with SHA-256 digests of the ids (decimal, comma-joined) and of the decoded text in their place."""
    return _run(docs, path, id_col, text_col, whole=False)


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, whole: bool) -> DataFrame:
    kept = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()
    tail = "ids array<int>, decoded string" if whole else "ids_sha256 string, decoded_sha256 string"
    names = ["doc_id", "n_tokens", *(["ids", "decoded"] if whole else ["ids_sha256", "decoded_sha256"])]
    common.by_bytes(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # a few MB, whatever the corpus

    def digest(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shipped.value)
        common.give_back()  # what reading the vocabulary took
        decimal = [] if whole else list(map(str, range(max(coder.automaton.labels, default=0) + 1)))
        for batch in it:
            start, n, held, ids_told, texts_told = 0, [], array("i"), [], []
            for k, text in enumerate(batch.column(1)):
                ids = coder.encode(text.as_py() or "")
                decoded = coder.decode(ids)
                n.append(len(ids))
                if whole:
                    held += ids
                    texts_told.append(decoded)
                else:
                    ids_told.append(digest(",".join(map(decimal.__getitem__, ids)).encode()))
                    texts_told.append(digest(decoded.encode()))
                if len(held) >= FLUSH_TOKENS or k == len(batch) - 1:
                    if whole:
                        ends = pa.array(np.cumsum([0, *n]), pa.int32())
                        told = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(held, np.int32)))
                    else:
                        told = pa.array(ids_told, pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(n)), pa.array(n, pa.int64()), told, pa.array(texts_told, pa.string())], names=names)
                    start, n, held, ids_told, texts_told = k + 1, [], array("i"), [], []
            del batch  # before the next is read
            common.give_back()
        coder.forget()  # the worker goes on to other stages
        common.give_back()

    return kept.mapInArrow(batches, f"doc_id {id_type}, n_tokens long, {tail}")
