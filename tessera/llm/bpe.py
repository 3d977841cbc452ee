"""BPE encoding and decoding with a tokenization automaton.

The automaton reads token labels and accepts just the sequences that byte-pair merging produces. It starts as one state
with an arc for each base symbol. Each merge (a, b) -> c, in order, applies a gadget: wherever an a-arc leads to a state
with a b-arc, a c-arc to the b-arc's end is added; then the a-arcs lead to a copy of their end that lacks the b-arc. The
end of an arc depends on its label alone, so there is one state for each label besides the start, and the table needs
no copies: it holds, for a state and a label, the step at which that arc was taken away. A label made later has an arc
just where its left part still had one at that step; the state of c has lost, up to its making, what that of b had lost.

A word's prefix has exactly one accepted path, so encoding goes through the word once, keeping for every position the
label of the arc that ends there. Transitions that were looked up stay in a table of their own. Decoding emits labels.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
#: Bytes of words and ids that a Python worker keeps. An entry's objects take ENTRY bytes besides its characters.
CACHE_BYTES, ENTRY = 40_000_000, 200
#: Transitions that a worker keeps.
ARCS = 200_000
#: The endings that the tokenizer's pattern splits off.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


#: The White_Space code points of Unicode.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@cache
def pieces(top: int) -> re.Pattern[str]:
    """Endings, runs of letters, single numbers, runs of what is neither nor white space, for texts of code points up to
    ``top``. Categories are spelled out for ``re``, which is several times as fast up to U+FFFF as a matcher with names."""
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(top + 1)])

    def inside(kind: str) -> str:
        points = np.flatnonzero(kinds == kind)
        runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
        return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)

    letters, numbers = inside("L"), inside("N")
    return re.compile("|".join(ENDINGS) + f"|[{letters}]+|[{numbers}]|[^{letters}{numbers}{WHITE}]+")


@contextmanager
def no_collection() -> Iterator[None]:
    """Without cycle collection, which would go through the caches' many small objects in vain."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Words(dict):
    """piece -> its ids, joined by single spaces; encodes what it lacks. Two generations: when the younger takes half the
    bytes it becomes the older, whose words come back when they are met and else go with it."""

    def __init__(self, encode: Callable[[str], str]) -> None:
        self.encode, self.bytes, self.older = encode, 0, {}

    def __missing__(self, piece: str) -> str:
        found = self.older.pop(piece, None)
        if found is None:
            found = self.encode(piece)
        self.bytes += ENTRY + 2 * len(piece) + len(found)
        if self.bytes > CACHE_BYTES // 2:
            self.older, self.bytes = dict(self), 0
            self.clear()
        self[piece] = found
        return found


def byte_symbols() -> dict[int, str]:
    """Printable stand-ins of bytes: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass
class Automaton:
    """One state per label (a token id) besides the start (-1). ``left``, ``right``, ``rank``: a token's parts and the
    step of its merge (-1 for base symbols). ``taken``: state * 2**20 + label -> the step at which the arc was taken away."""

    labels: list[str]
    ids: dict[str, int]
    left: list[int]
    right: list[int]
    rank: list[int]
    taken: dict[int, int] = field(default_factory=dict)
    arcs: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.befores: dict[int, list[tuple[int, int]]] = {}
        self.afters: dict[int, list[tuple[int, int]]] = {}
        self.trie: dict = {}

    def _spellings(self) -> dict:
        """Labels by their symbols; a node is (next symbols, its token, its token with the end mark)."""
        for text, token in self.ids.items():
            node = [self.trie]
            for symbol in text.removesuffix(END):
                node = node[0].setdefault(symbol, [{}, None, None])
            node[2 if text.endswith(END) else 1] = token
        return self.trie

    def _chain(self, token: int, part: list[int], less: int) -> list[tuple[int, int]]:
        """A token, then its outer parts inwards, each with the last step that counts for it."""
        out = [(token, 1 << 60)]
        while self.rank[token] >= 0:
            out.append((part[token], self.rank[token] - less))
            token = part[token]
        return out

    def has_arc(self, state: int, token: int) -> bool:
        if state < 0:
            return True
        before = self.befores.get(state) or self.befores.setdefault(state, [(s << 20, k) for s, k in self._chain(state, self.right, 1)])
        after = self.afters.get(token) or self.afters.setdefault(token, self._chain(token, self.left, 0))
        taken = self.taken
        for t, last in after:
            for s, own in before:
                if (s | t) in taken and taken[s | t] <= last and taken[s | t] <= own:
                    return False
        return True

    def encode(self, symbols: str) -> list[int]:
        """Tokens of a word of base symbols; its last symbol carries the end mark."""
        n = len(symbols)
        arcs, trie = self.arcs, self.trie or self._spellings()
        if len(arcs) > ARCS:
            arcs.clear()
        ends = [-1] + [None] * n
        for j in range(n):
            kids, base, i = trie, ends[j] + 1 << 20, j
            for symbol in symbols[j:]:
                node = kids.get(symbol)
                if node is None:
                    break
                i += 1
                kids, t, last = node
                if i == n:
                    t = last
                if t is not None and ends[i] is None:
                    if not base:
                        ends[i] = t  # the start has all arcs
                        continue
                    found = arcs.get(base | t)
                    if found is None:
                        found = arcs[base | t] = self.has_arc(ends[j], t)
                    if found:
                        ends[i] = t
        out, i = [], n
        while i:
            out.append(ends[i])
            i -= len(self.labels[ends[i]].removesuffix(END)) if i == n else len(self.labels[ends[i]])
        return out[::-1]


def compile_automaton(vocab: dict[str, int], merges: list[tuple[str, str]]) -> Automaton:
    """Applies the gadgets of all merges in order. A merge that its forerunners make impossible adds no arc."""
    size = max(vocab.values()) + 1
    labels = [""] * size
    for text, i in vocab.items():
        labels[i] = text
    a = Automaton(labels, {}, [-1] * size, [-1] * size, [-1] * size)
    made = {x + y for x, y in merges}
    a.ids.update({text: i for text, i in vocab.items() if text not in made})
    for k, (x, y) in enumerate(merges):
        left, right = a.ids.get(x), a.ids.get(y)
        if left is None or right is None or not a.has_arc(left, right):
            continue
        new = vocab[x + y]
        a.ids[x + y], a.left[new], a.right[new], a.rank[new] = new, left, right, k
        a.taken[left << 20 | right] = k
    return a


@dataclass
class WordTokenizer:
    """A word-end BPE tokenizer file: NFC, lower case, white space dropped, pieces by pattern, bytes as symbols."""

    automaton: Automaton
    special: dict[str, int]

    @classmethod
    def from_file(cls, path: str) -> WordTokenizer:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        return cls(compile_automaton({k: v for k, v in model["vocab"].items() if k not in special}, merges), special)

    def __post_init__(self) -> None:
        self.symbols = byte_symbols()
        self.words = Words(self._word)
        names = {v: k for k, v in self.special.items()}
        self.names = {str(i): names.get(i) or label for i, label in enumerate(self.automaton.labels)}
        self.names.update({str(i): name for i, name in names.items()})
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __getstate__(self) -> dict:
        return {"automaton": self.automaton, "special": self.special}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _word(self, piece: str) -> str:
        plain = piece.isascii() and piece.isalnum()  # such bytes stand for themselves
        symbols = piece if plain else "".join(map(self.symbols.__getitem__, piece.encode("utf-8")))
        return " ".join(map(str, self.automaton.encode(symbols)))

    def encode_joined(self, text: str | None) -> tuple[str, str]:
        """(ids, labels) of a whole text, each joined by single spaces; null is an empty text."""
        out: list[str] = []
        for part in self.split.split(text or "") if self.split else [text or ""]:
            if part in self.special:
                out.append(str(self.special[part]))
                continue
            part = (part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")).lower()
            out += map(self.words.__getitem__, pieces(0xFFFF if len(part.encode('utf-16-le')) == 2 * len(part) else 0x10FFFF).findall(part))
        ids = " ".join(out)
        return ids, " ".join(map(self.names.__getitem__, ids.split()))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_joined(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels, joined as the tokenizer's file has no decoder: by single spaces."""
        return " ".join([self.names[str(i)] for i in ids])


def encode_table(docs: DataFrame, tokenizer: WordTokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of every row: token ids as an array, and the text that they decode to. Null and empty texts
    have no ids; repeated rows each come back; an empty table gives none."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [sent.value.encode_joined(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(map(int, i.split())) for i, _ in both], pa.list_(pa.int32())), pa.array([d for _, d in both], pa.string())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digest_table(docs: DataFrame, tokenizer: WordTokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have no tokens;
    repeated rows each come back alike; an empty table gives none; other columns are left out, whatever they are called."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, texts = [], [], []
            with no_collection():
                for t in b.column(1):
                    i, d = sent.value.encode_joined(t.as_py())
                    n.append(i.count(" ") + 1 if i else 0)
                    ids.append(sha(i))
                    texts.append(sha(d))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
