"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

Distinct words of a batch are walked in sorted order, which is the depth-first order of their
trie. Each trie node keeps one state: the last token of the encoding of the prefix that it
stands for. A word's state at a node follows from the states above it alone, so the encoding of
a prefix that many words share is worked out once.

Why one token a node is enough: if a prefix p ends with token t, then its encoding is that of p
without t, and then t. Token t is the longest one that p ends with for which the pair (last token
before t, t) is stable, meaning that no merge across their border would come before a merge
that built one of the two.
"""

from __future__ import annotations

import json
import sys

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import chunks, small_batches

#: Words whose encodings a worker keeps; beyond that, only those of the texts at hand.
CACHE_WORDS = 150_000
#: Pairs of tokens whose stability a worker keeps, likewise.
CACHE_PAIRS = 200_000
#: Characters of texts that are cut into words at a time; the words of more than these would be most of a worker's memory.
ENCODED_CHARS = 250_000
#: Longest word that is kept; longer ones are encoded each time they occur.
CACHE_CHARS = 200

# Fixed value: the pattern of the byte-level pre-tokenizer, white space spelt out.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter by which a byte-level vocabulary file writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE file; file: the text of its JSON."""

    def __init__(self, file: str):
        model, letters = json.loads(file), byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        ids = {as_bytes(t): i for t, i in model["model"]["vocab"].items() if t not in self.added}
        self.bytes_of = {i: b for b, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        # tokens by age: single bytes first, then in order of their merges
        self.tokens = [bytes([b]) for b in range(256)]
        age = {t: a for a, t in enumerate(self.tokens)}
        self.halves: list[tuple[int, int] | None] = [None] * 256
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = age[as_bytes(left)], age[as_bytes(right)]
            whole = self.tokens[pair[0]] + self.tokens[pair[1]]
            if whole not in age:
                age[whole] = len(self.tokens)
                self.tokens.append(whole)
                self.halves.append(pair)
                self.merged[pair] = age[whole]
        self.stable: dict[tuple[int, int], bool] = {}
        whole = [h is None or self.survives(*h, a) for a, h in enumerate(self.halves)]
        for a, h in enumerate(self.halves):
            if h:
                whole[a] = whole[a] and whole[h[0]] and whole[h[1]]
        self.age = {t: a for a, t in enumerate(self.tokens) if whole[a]}
        # finds all tokens that end at each place of a word, longest first
        self.finder = ahocorasick.Automaton()
        for t, a in self.age.items():
            self.finder.add_word(t.decode("latin-1"), (a, len(t)))
        self.finder.make_automaton()
        self.packed = [np.uint32(ids.get(t, 0)).tobytes() for t in self.tokens]
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def survives(self, a: int, b: int, before: int) -> bool:
        """Whether no merge across the border of tokens a and b is older than before, or comes ahead of one inside them."""
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                return False
            # undo the younger token's last merge; at a draw the left token's came first
            ha, hb = self.halves[a], self.halves[b]
            if ha is None and hb is None:
                return True
            if a > b:
                before, a = a, ha[1]
            else:
                before, b = b + 1, hb[0]

    def is_stable(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart; kept for the next time."""
        known = self.stable.get((left, right))
        if known is None:
            known = self.stable[left, right] = self.survives(left, right, len(self.tokens))
        return known

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of distinct words, by one traversal of their trie."""
        is_stable, stable, tokens, packed, ends = self.is_stable, self.stable, self.tokens, self.packed, self.finder.iter
        out: dict[bytes, bytes] = {}
        state: list[int] = []  # state[i]: the last token of the path's first i + 1 bytes
        path = b""
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del state[shared:]
            known = shared
            for end, (t, size) in ends(word.decode("latin-1")):
                if end < known:
                    continue
                if size <= end:
                    pair = state[end - size], t
                    ok = stable.get(pair)
                    if not (is_stable(*pair) if ok is None else ok):
                        continue
                state.append(t)
                known += 1
            path, at, parts = word, len(word), []
            while at:
                t = state[at - 1]
                parts.append(packed[t])
                at -= len(tokens[t])
            out[word] = b"".join(reversed(parts))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts; the words of one call go through one trie."""
        cache = self.cache
        pieces = []  # of each text: words, and ids of added tokens
        for t in texts:
            parts, at = [], 0
            for m in self.split.finditer(t) if self.split else ():
                parts += [self.pattern.findall(t[at : m.start()]), self.added[m.group()]]
                at = m.end()
            parts.append(self.pattern.findall(t[at:] if at else t))
            pieces.append(parts)
        words = set().union(*(p for parts in pieces for p in parts if not isinstance(p, int)))
        if len(cache) + len(words) > CACHE_WORDS:  # words that these texts hold as well stay
            again = {w: cache[w] for w in words if w in cache}
            cache.clear()
            cache.update(again)
        if len(self.stable) > CACHE_PAIRS:
            self.stable.clear()
        new = {w: w.encode("utf-8", "surrogatepass") for w in words if w not in cache}
        coded = self.encode_words(list(new.values()))
        cache.update((w, coded[b]) for w, b in new.items())
        out = [b"".join(np.uint32(p).tobytes() if isinstance(p, int) else b"".join(map(cache.__getitem__, p)) for p in parts) for parts in pieces]
        for w in new:
            if len(w) > CACHE_CHARS:
                del cache[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def forget(self) -> None:
        """Free what was kept for the next texts."""
        self.cache.clear()
        self.stable.clear()


def vocabulary(file: str) -> Vocabulary:
    """Kept by the worker process from task to task."""
    kept = sys.__dict__.setdefault("_tracewell_bpe", {})
    key = hash(file)
    if key not in kept:
        kept.clear()
        kept[key] = Vocabulary(file)
    return kept[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), back: str | None = None, same: str | None = None) -> DataFrame:
    """(id_col, columns `keep`, ids): the ids of every whole text as little-endian unsigned 32-bit integers in a binary column.

    path: a byte-level BPE file of the tokenizers library, read on the driver. Ids are those of that
    library with add_special_tokens=False; added tokens that stand in a text get their own ids. With
    `back`, a column of that name holds the text that the ids decode to; with `same`, one says whether that
    is the text itself (null: empty), so that neither text leaves the task. Null and empty texts have no ids. Rows come one to one: repeated rows are encoded each, null ids stay null, columns not named
    are left out, and an empty table gives an empty result.
    """
    with open(path, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)
    names = [id_col, *keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", ids binary" + (f", `{back}` string" if back else "") + (f", `{same}` boolean" if same else "")
    names_out = [*names, "ids", *([back] if back else []), *([same] if same else [])]

    def run(batches):
        pa.default_memory_pool().release_unused()  # what a stage before left in this worker
        vocab = vocabulary(file.value)
        for rb in batches:
            texts = rb.column("_text").to_pylist()
            for a, b in chunks(texts, ENCODED_CHARS):
                part = [t or "" for t in texts[a:b]]
                coded = vocab.encode(part)
                more = [pa.array(map(vocab.decode, coded), pa.string())] if back else []
                more += [pa.array([vocab.decode(c) == t for c, t in zip(coded, part)], pa.bool_())] if same else []
                yield pa.RecordBatch.from_arrays([*(rb.column(c).slice(a, b - a) for c in names), pa.array(coded, pa.binary()), *more], names=names_out)
        vocab.forget()

    return docs.select(*names, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded with a column text for its column ids; bytes that are no UTF-8 become U+FFFD, null ids the empty text."""
    with open(path, encoding="utf-8") as f:
        file = coded.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in coded.columns if c != "text"]

    def run(batches):
        vocab = vocabulary(file.value)
        for rb in batches:
            texts = [vocab.decode(x or b"") for x in rb.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    schema = ", ".join(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in names)
    return coded.select(*names).mapInArrow(run, f"{schema}, text string")
