"""Language-model scoring by a probabilistic suffix tree over words.

The root is the add-half unigram distribution of all training tokens. A context of one to DEPTH
words is a candidate if it makes up CONTEXT_SHARE of the training tokens, and it is retained if its
next-word distribution diverges from that of its longest retained suffix (a likelihood-ratio test).
Distributions are smoothed towards that suffix with a prior of STRENGTH tokens, and next words that
a state doesn't keep share what is left in the suffix's proportions. A token is scored in the state
of the longest retained suffix of the words before it.

Shares bound everything that is broadcast: at most 1 / WORD_SHARE words, 1 / CONTEXT_SHARE contexts
and 1 / PAIR_SHARE next words at each depth, whatever the corpus. All other words keep exact counts
too: they meet the table of counts in a join, by 64-bit hashes.

Contexts of DEPTH words below the share are candidates as well, from LEAST occurrences on, however
large the corpus: they are never broadcast. Every place with such a context goes, packed, to the task
that counts its context, which applies the same divergence test and the same smoothing (over the
probability by the broadcast tree, sent with the place) and sends back what each text gains. So what
is gathered grows with the corpus. A context in one task holds less than CONTEXT_SHARE of the training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import batch, chunks, numbered_words, small_batches, word_hashes
from tracewell.storage import shipped, stored

DEPTH = 3
WORD_SHARE, CONTEXT_SHARE, PAIR_SHARE = 2.5e-7, 1e-5, 1e-6
#: Tokens of prior weight that a state gives to its suffix's distribution.
STRENGTH = 4.0
#: Log-likelihood (nats) that a context must gain over its suffix, at least and for each next word it keeps.
GAIN, GAIN_PER_WORD = 6.0, 2.0
#: Keys that a task holds before it hands their counts on.
HELD = 1_500_000
#: Occurrences from which on a context of DEPTH words, and a next word in it, can be kept whatever their share.
LEAST = 2
#: Places that a task packs at a time, and training tokens for each task that counts contexts.
PACKED, COUNTED = 1_000_000, 1_200_000
#: Bits of a context's hash inside its task, and the fixed point of negative logarithms.
SLOT_BITS, FIXED = 36, 1000
#: Stands for the end of a text; no word is empty.
END = b""


class Summed:
    """Counts of integer keys, merged in a worker before they are shuffled."""

    schema = pa.schema([("key", pa.int64()), ("c", pa.int64())])

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None):
        """Yields batches when too much is held."""
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys.astype(np.int64, copy=False), counts.astype(np.int64, copy=False)))
        self.size += len(keys)
        if self.size > HELD:
            self.merge()
            if self.size > HELD // 2:
                yield from self.rest()

    def merge(self):
        if len(self.parts) > 1:
            keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in self.parts]).astype(np.float64)).astype(np.int64)
            self.parts, self.size = [(keys, counts)], len(keys)

    def rest(self):
        self.merge()
        if self.parts:
            keys, counts = self.parts[0]
            for a in range(0, len(keys), 100_000):
                yield batch(self.schema, key=keys[a : a + 100_000], c=counts[a : a + 100_000])
        self.parts, self.size = [], 0


def _tokens(texts: list):
    """(hashes of distinct words, word numbers of all tokens in a row with an end after each text, tokens of each text)."""
    words, ids, counts = numbered_words(texts)
    full = np.empty(len(ids) + len(texts), np.int64)
    ends = np.cumsum(counts + 1) - 1
    inside = np.ones(len(full), bool)
    inside[ends] = False
    full[inside] = ids
    full[ends] = len(words)
    return word_hashes([*words, END]).view(np.int64), full, counts + 1


def _count_words(batches):
    total = Summed()
    for rb in batches:
        texts = rb.column("text").to_pylist()
        for a, b in chunks(texts):
            h, ids, _ = _tokens(texts[a:b])
            yield from total.add(h, np.bincount(ids, minlength=len(h)))
    yield from total.rest()


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 for those that are not in it."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


class Tree:
    """words, counts: frequent words by hash. levels: for each depth, candidate contexts and next words.

    A context is known by code: the number of the context without its last word (0 for none),
    times the number of frequent words, plus the last word's number.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        self.words, self.counts, self.total, self.distinct = words, counts, total, distinct
        self.levels: list[dict[str, np.ndarray]] = []

    @property
    def norm(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def contexts(self, ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """For each depth, the candidate context that ends with each token, or -1; starts: places where texts begin."""
        out, last = [], None
        for level in self.levels:
            at = np.full(len(ids), -1)
            if not out:  # one word: by its number
                ok = np.flatnonzero(ids >= 0)
                at[ok] = self.single[ids[ok]]
            else:
                ok = np.flatnonzero((last >= 0) & (ids >= 0))
                at[ok] = _lookup(level["code"], last[ok] * len(self.words) + ids[ok])
            out.append(at)
            last = np.full(len(ids), -1)
            last[1:] = at[:-1]
            last[starts] = -1
        return out

    def grow(self, code: np.ndarray, seen: np.ndarray) -> None:
        """Add a level of candidate contexts, sorted by code, that occur `seen` times each."""
        if not self.levels:
            self.single = np.full(len(self.words), -1, np.int32)
            self.single[code] = np.arange(len(code))
        self.levels.append({"code": code, "seen": seen, "kept": np.zeros(len(code), bool), "rest": np.ones(len(code)), "key": np.zeros(0, np.int64), "c": np.zeros(0, np.int64)})

    def learn(self, key: np.ndarray, c: np.ndarray, suffixes: np.ndarray) -> None:
        """Fill the last level: counts of key = context * words + next word, sorted. suffixes: for each context, its suffix of each shorter depth, or -1."""
        level, many = self.levels[-1], len(self.words)
        context, word = key // many, key % many
        low = (self.counts[word] + 0.5) / self.norm
        for d in range(len(self.levels) - 1):
            low = self.refine(d, suffixes[context, d], word, low)
        seen = level["seen"][context]
        gain = np.bincount(context, c * np.log(c / (seen * low)), minlength=len(level["code"]))
        kept_c = np.bincount(context, c, minlength=len(level["code"]))
        kept_p = np.bincount(context, low, minlength=len(level["code"]))
        other = np.maximum(level["seen"] - kept_c, 0)
        left = np.maximum(1 - kept_p, 1e-12)
        gain += np.where(other > 0, other * np.log(np.maximum(other, 1e-300) / (level["seen"] * left)), 0)
        level["rest"] = (other + STRENGTH * left) / ((level["seen"] + STRENGTH) * left)
        level["kept"] = gain >= GAIN + GAIN_PER_WORD * np.bincount(context, minlength=len(level["code"]))
        good = level["kept"][context]
        level["key"], level["c"] = key[good], c[good]

    def refine(self, depth: int, context: np.ndarray, word: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities of words one retained context deeper; a word of -1 is not frequent."""
        level = self.levels[depth]
        at = np.flatnonzero(context >= 0)
        at = at[level["kept"][context[at]]]
        p = p.copy()
        if len(at):
            found = _lookup(level["key"], context[at] * len(self.words) + word[at])
            kept = (found >= 0) & (word[at] >= 0)
            low, state = p[at], context[at]
            low[kept] = (level["c"][found[kept]] + STRENGTH * low[kept]) / (level["seen"][state[kept]] + STRENGTH)
            low[~kept] *= level["rest"][state[~kept]]
            p[at] = low
        return p


def _count_next(tree):
    """Counts of (deepest candidate context, next frequent word)."""

    def run(batches):
        t, total = tree(), Summed()
        for rb in batches:
            texts = rb.column("text").to_pylist()
            for a, b in chunks(texts):
                h, ids, counts = _tokens(texts[a:b])
                ids = _lookup(t.words, h)[ids]
                starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
                context = t.contexts(ids, starts)[-1]
                last = np.full(len(ids), -1)
                last[1:] = context[:-1]
                last[starts] = -1
                ok = (last >= 0) & (ids >= 0)
                yield from total.add(last[ok] * len(t.words) + ids[ok])
        yield from total.rest()

    return run


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of integers, byte by byte, which compresses better."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _from_planes(raw: bytes, at: int, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
    return out.view("<u8").ravel()


def _context_hashes(h: np.ndarray) -> np.ndarray:
    """For each token the hash of the DEPTH tokens before it, given the tokens' hashes; the first DEPTH are meaningless."""
    key = np.zeros(len(h), np.uint64)
    for back in range(DEPTH, 0, -1):
        x = (key ^ np.roll(h, back)) * np.uint64(0x9E3779B97F4A7C15)
        key = x ^ (x >> np.uint64(29))
    return (key * np.uint64(0xBF58476D1CE4E5B9)) ^ (key >> np.uint64(32))


class Places:
    """Places in texts whose contexts are counted elsewhere, until they are packed: a context's hash, the next word
    (0 if it is not frequent), the text and the probability so far."""

    def __init__(self, tasks: int):
        self.tasks, self.parts, self.size, self.uids, self.learned = tasks, [], 0, [], []

    def add(self, uids: np.ndarray, learned: np.ndarray, key: np.ndarray, word: np.ndarray, text: np.ndarray, low: np.ndarray) -> None:
        docs = sum(map(len, self.uids))
        self.parts.append((key, word.astype(np.uint16), (text + docs).astype(np.int32), low.astype(np.uint16)))
        self.size += len(key)
        self.uids.append(uids)
        self.learned.append(learned)

    @property
    def full(self) -> bool:
        return self.size >= PACKED or sum(map(len, self.uids)) > 50_000

    def packed(self):
        """(task, places, size unpacked, blob) for each task that counts some of them; nothing is held afterwards."""
        if self.size:
            key, word, text, low = (np.concatenate(x) for x in zip(*self.parts))
            uids, learned = np.concatenate(self.uids), np.concatenate(self.learned)
            task = ((key >> np.uint64(32)) * np.uint64(self.tasks)) >> np.uint64(32)
            slot = key & np.uint64((1 << SLOT_BITS) - 1)
            order = np.lexsort((slot, task))
            cuts = np.searchsorted(task[order], np.arange(self.tasks + 1, dtype=np.uint64))
            for t in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[t] : cuts[t + 1]]
                docs, local = np.unique(text[at], return_inverse=True)
                gaps = np.diff(slot[at], prepend=np.uint64(0))
                raw = b"".join([_planes(gaps, 5), _planes(word[at], 2), _planes(local, 2), _planes(low[at], 2), uids[docs].tobytes(), learned[docs].tobytes()])
                yield t, len(at), len(raw), pa.compress(raw, codec="zstd", asbytes=True)
        self.parts, self.size, self.uids, self.learned = [], 0, [], []


def _unpacked(n: int, size: int, blob: bytes):
    """(slots, words, texts, probabilities in fixed point, uids, learned) of a blob."""
    raw = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)
    docs = (size - 11 * n) // 9
    slot = np.cumsum(_from_planes(raw, 0, n, 5))
    word, text, low = (_from_planes(raw, at * n, n, 2) for at in (5, 7, 9))
    return slot, word, text, low, np.frombuffer(raw, np.int64, docs, 11 * n), np.frombuffer(raw, bool, docs, 11 * n + 8 * docs)


def gains(code: np.ndarray, low: np.ndarray, learned: np.ndarray) -> np.ndarray:
    """What each place adds to the log10 probability of its text by the states of its context.

    code: context << 16 | next word; low: -ln of the probability so far, in fixed point; learned: places of training texts.
    """
    out = np.zeros(len(code))
    if not len(code):
        return out
    order = np.argsort(code)
    first = lambda x: np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    row = code[order]
    starts = first(row)
    pair = row[starts]
    del row
    c = np.add.reduceat(learned[order], starts, dtype=np.int64)
    p = np.exp(np.minimum.reduceat(low[order], starts) / -float(FIXED))
    heads = first(pair >> np.uint64(16))
    context = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(pair))))
    seen = np.add.reduceat(c, heads)
    kept = (c >= LEAST) & ((pair & np.uint64(65535)) != 0)
    at, held, q = context[kept], c[kept], p[kept]
    total = lambda v=None: np.bincount(at, v, len(heads)).astype(np.float64)
    other, left = seen - total(held), np.maximum(1 - total(q), 1e-12)
    gain = total(held * np.log(held / (seen[at] * q)))
    gain += np.where(other > 0, other * np.log(np.maximum(other, 1e-300) / (np.maximum(seen, 1) * left)), 0)
    state = (total() > 0) & (gain >= GAIN + GAIN_PER_WORD * total())
    rest = np.log10(np.maximum(other + STRENGTH * left, 1e-300) / ((seen + STRENGTH) * left))
    more = rest[context]
    more[kept] = np.log10((held + STRENGTH * q) / ((seen[at] + STRENGTH) * q))
    more[~state[context]] = 0
    out[order] = np.repeat(more, np.diff(np.append(starts, len(code))))
    return out


_TEXT = pa.schema([("uid", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64()))])
_SENT = pa.schema([("task", pa.int32()), ("flush", pa.int64()), ("places", pa.int64()), ("size", pa.int64()), ("blob", pa.binary())])
_GAINED = pa.schema([("flush", pa.int64()), ("uids", pa.list_(pa.int64())), ("gains", pa.list_(pa.float32()))])


def _joined(n: int, *parts) -> pa.RecordBatch:
    """One batch of n rows from record batches, and of schemas whose columns are null there."""
    names, arrays = [], []
    for x in parts:
        names += x.schema.names if isinstance(x, pa.RecordBatch) else x.names
        arrays += x.columns if isinstance(x, pa.RecordBatch) else [pa.nulls(n, f.type) for f in x]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _score(tree, keep: tuple[str, ...], held_out: str, tasks: int):
    """Rows of texts by the broadcast tree, and rows of packed places for each task that counts contexts."""

    def run(batches):
        from pyspark import TaskContext

        t, seed, flush, places = tree(), TaskContext.get().partitionId(), 0, Places(tasks)
        kinds = None

        def sent():
            nonlocal flush
            for task, n, size, blob in places.packed():
                one = batch(_SENT, task=[task], flush=[(seed << 32) + flush], places=[n], size=[size], blob=[blob])
                yield _joined(1, kinds, _TEXT, one)
            flush += 1

        for rb in batches:
            texts = rb.column("text").to_pylist()
            kinds = pa.schema([rb.schema.field(c) for c in keep])
            for a, b in chunks(texts):
                h, numbers, counts = _tokens(texts[a:b])
                ids = _lookup(t.words, h)[numbers]
                ends = np.cumsum(counts)
                starts = ends - counts
                known = ids >= 0
                p0 = np.ones(len(ids))
                if known.any():
                    p0[known] = (t.counts[ids[known]] + 0.5) / t.norm
                p, last = p0, np.full(len(ids), -1)
                found = t.contexts(ids, starts)
                for d, context in enumerate(found):
                    last = np.full(len(ids), -1)
                    last[1:] = context[:-1]
                    last[starts] = -1
                    p = t.refine(d, last, ids, p)
                add = lambda v: np.add.reduceat(v, starts)
                rare = h[numbers[~known]]
                left = add((~known).astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left))), pa.int32()), pa.array(rare, pa.int64()))
                # equal texts of a partition share their uid; it is the same when the partition is read again
                uid = np.fromiter((xxhash.xxh3_64_intdigest((x or "").encode("utf-8", "surrogatepass"), seed) for x in texts[a:b]), np.uint64, b - a).view(np.int64)
                out = batch(_TEXT, uid=uid, n_tokens=counts, n_known=add(known.astype(np.int64)), base=add(np.log10(p0)), score=add(np.log10(p)), rare=lists)
                # places with DEPTH words before them, in contexts that the tree doesn't hold
                owner = np.repeat(np.arange(b - a), counts)
                far = np.arange(len(ids)) - starts[owner] >= DEPTH
                at = np.flatnonzero(far & (last < 0) if len(found) == DEPTH else far)
                hashes = h.view(np.uint64)[numbers]
                low = np.minimum(np.rint(-np.log(p[at]) * FIXED), 65535)
                word = np.where(known[at], 1 + hashes[at] % np.uint64(65535), 0)
                learned = ~rb.column(held_out).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                places.add(uid, learned, _context_hashes(hashes)[at], word, owner[at], low)
                rows = pa.RecordBatch.from_arrays([rb.column(c).slice(a, b - a) for c in keep], schema=kinds)
                # a text's row goes to any of the tasks, by its uid
                to = (uid.view(np.uint64) % np.uint64(tasks)).astype(np.int32)
                yield _joined(b - a, rows, out, batch(pa.schema([_SENT.field("task")]), task=to), pa.schema(list(_SENT)[1:]))
                if places.full:
                    yield from sent()
        yield from sent()

    return run


def _count_contexts(keep: tuple[str, ...]):
    """Rows of texts as they come, then a row of what texts gain for each blob of a task."""

    def run(batches):
        flushes, docs, parts, kinds, seen = [], [], [], None, 0
        for rb in batches:
            kinds = pa.schema([rb.schema.field(c) for c in keep])
            blob = rb.column("blob")
            rows = rb.filter(blob.is_null())
            if rows.num_rows:
                yield _joined(rows.num_rows, rows.select([*keep, *_TEXT.names]), _GAINED)
            for i in np.flatnonzero(blob.is_valid().to_numpy(zero_copy_only=False)).tolist():
                slot, word, text, low, uids, learned = _unpacked(rb.column("places")[i].as_py(), rb.column("size")[i].as_py(), blob[i].as_py())
                flushes.append(rb.column("flush")[i].as_py())
                docs.append(uids)
                parts.append(((slot << np.uint64(16)) | word, low.astype(np.uint16), learned[text], (text + np.uint64(seen)).astype(np.int32)))
                seen += len(uids)
        if parts:
            code, low, learned, owner = (np.concatenate(x) for x in zip(*parts))
            del parts
            total, at = np.bincount(owner, gains(code, low, learned), seen), 0
            for flush, uids in zip(flushes, docs):
                mine = total[at : at + len(uids)]
                at, some = at + len(uids), np.flatnonzero(mine)
                if len(some):
                    yield _joined(1, kinds, _TEXT, batch(_GAINED, flush=[flush], uids=[uids[some].tolist()], gains=[mine[some].tolist()]))

    return run


def _summed_gains(table: pa.Table) -> pa.Table:
    """(uid, more): the gains of the texts of one flush, summed over the tasks that counted their contexts."""
    table = table.combine_chunks()
    uids, at = np.unique(table.column("uids").combine_chunks().flatten().to_numpy(), return_inverse=True)
    return pa.table({"uid": uids, "more": np.bincount(at, table.column("gains").combine_chunks().flatten().to_numpy().astype(np.float64), len(uids))})


def fit(docs: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree of all texts of docs, and the table (key, c) of the counts of all tokens by hash."""
    texts = docs.select("text")
    words = stored(texts.mapInArrow(_count_words, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "words")
    size = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = size.n or 0, size.v
    often = words.where(F.col("c") >= total * WORD_SHARE).toArrow()
    key, c = often.column("key").to_numpy(), often.column("c").to_numpy()
    order = np.argsort(key)
    tree = Tree(key[order], c[order], total, distinct)
    code, seen = np.arange(len(key), dtype=np.int64), tree.counts
    end = _lookup(tree.words, word_hashes([END]).view(np.int64))[0]
    suffixes = np.zeros((len(code), 0), np.int64)
    for depth in range(DEPTH):
        # contexts by frequency; nothing follows the end of a text
        good = (seen >= total * CONTEXT_SHARE) & (code % max(1, len(tree.words)) != end)
        if not good.any():
            break
        tree.grow(code[good], seen[good])
        suffixes = suffixes[good]
        counted = texts.mapInArrow(_count_next(shipped(docs.sparkSession, tree)), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
        pairs = counted.where(F.col("c") >= max(2, total * PAIR_SHARE)).toArrow()
        key, c = pairs.column("key").to_numpy(), pairs.column("c").to_numpy()
        order = np.argsort(key)
        key, c = key[order], c[order]
        tree.learn(key, c, suffixes)
        # a context one word longer is a pair of this level; its suffixes lack the oldest word
        many = len(tree.words)
        context, word = key // many, key % many
        longer = np.full((len(key), depth + 1), -1)
        for d in range(depth + 1):
            # the suffix of d + 1 words: that of the context's last d words, and the word
            short = np.zeros(len(key), np.int64) if d == 0 else (suffixes[context, d - 1] if d - 1 < suffixes.shape[1] else context)
            ok = short >= 0
            longer[ok, d] = _lookup(tree.levels[d]["code"], short[ok] * many + word[ok])
        code, seen, suffixes = key, c, longer
    return tree, words


def score(docs: DataFrame, tree: Tree, words: DataFrame, keep: tuple[str, ...], held_out: str = "held_out") -> DataFrame:
    """docs' columns `keep` with n_tokens, n_known, train_tokens, base_score and score of every row's whole text.

    Rows whose column `held_out` is false are those that the tree was fitted on; contexts below its shares are
    counted in them here.
    """
    shared = shipped(docs.sparkSession, tree)
    tasks = tree.total // COUNTED + 1
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + "uid long, n_tokens long, n_known long, base double, score double, rare array<long>"
    sent = docs.select(*dict.fromkeys([*keep, held_out, "text"])).mapInArrow(_score(shared, keep, held_out, tasks), f"{schema}, task int, flush long, places long, size long, blob binary")
    rows = stored(sent.repartitionById(tasks, F.col("task")).mapInArrow(_count_contexts(keep), f"{schema}, flush long, uids array<long>, gains array<float>"), "scored")
    texts = rows.where("n_tokens is not null")
    if tree.total:
        rare = texts.select("uid", F.explode("rare").alias("key")).join(words.where(F.col("c") < tree.total * WORD_SHARE), "key", "left")
    else:
        rare = texts.select("uid", F.explode("rare").alias("key"), F.lit(None).cast("long").alias("c"))
    part = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(tree.norm))
    deep = rows.where("uids is not null").select("flush", "uids", "gains").groupBy("flush").applyInArrow(_summed_gains, "uid long, more double")
    none, no = F.lit(0.0), F.lit(0).cast("long")
    every = rare.select("uid", part.alias("rare"), F.when(F.col("c").isNull(), 0).otherwise(1).cast("long").alias("seen"), none.alias("deep"), no.alias("copies"))
    every = every.union(deep.select("uid", none, no, "more", no)).union(texts.select("uid", none, no, none, F.lit(1).cast("long")))
    sums = every.groupBy("uid").agg(*(F.sum(c).alias(f"{c}_sum") for c in ("rare", "seen", "deep", "copies")))
    # equal texts of a partition share a uid, and each of them has its part of the sums
    mine = lambda c: F.col(f"{c}_sum") / F.col("copies_sum")
    return texts.join(sums, "uid").select(
        *keep, "n_tokens", (F.col("n_known") + F.round(mine("seen")).cast("long")).alias("n_known"), F.lit(tree.total).cast("long").alias("train_tokens"),
        (F.col("base") + mine("rare")).alias("base_score"), (F.col("score") + mine("rare") + mine("deep")).alias("score"))


def fit_and_score(docs: DataFrame, part: int = 1, of: int = 5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text).

    Rows whose crc32(doc_id as text) modulo `of` is `part`, and rows with a null doc_id, are held out of
    the training. Null texts count as empty: they have one token, the end. Repeated rows count and are
    scored each. Other columns are ignored; an empty table gives an empty result; without training
    tokens every token is unknown and has the probability 1.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == part, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    tree, words = fit(docs.where(~F.col("held_out")))
    return score(docs, tree, words, ("doc_id", "held_out"))
