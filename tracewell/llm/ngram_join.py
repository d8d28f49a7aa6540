"""Exact Jaccard self-join of word n-gram sets, with skipping by set relations.

Index-level skipping: each set enters the inverted index with a prefix of its n-grams (hot
n-grams ordered last). In an index list the entries stand in blocks of sizes, and an entry's place in
its prefix bounds the overlap that it can begin: blocks whose sizes can't link, and entries whose
place leaves too few n-grams for any partner in the list, are skipped. What is left of the lists
joins sets to families: two sets that link always meet in a list, so they are in one family.

Answer-level skipping: of a family only one set X is compared with all others in full. The others are
kept as what they share with X and what they have beyond it, and from X's answers follow theirs, by
the differences alone:

    |Y & Z| = |X & Y & Z| + |(Y - X) & (Z - X)|

The first part is a bitwise and of two masks over X. If it is enough by itself, Y and Z link; if even
the smaller of the two remainders, or what parity sketches of them leave possible, is not enough, they
don't; only then remainders are compared. Sets that links have joined already are not compared at
all. Families beyond BLOCK_BYTES are dealt to blocks; pairs of different blocks come from the index lists of
their sets: sizes, places and sketches of whole sets rule pairs out before sets are fetched, so that what moves
grows with the pairs that may link and not with blocks times sets. The result is exact: a pair is passed over
only if it cannot link or is in one component already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import batch, chunks, components, numbered_words, small_batches, word_hashes
from tracewell.storage import clean, discard, stored

#: Most ids that go to all tasks; more of them meet the documents in a join of both sides.
SENT_IDS = 2_000_000
#: Most sets whose families and blocks go to all tasks (40 bytes each); more of them meet theirs in a join of both sides.
SENT_SETS = 1_000_000
#: At most so many n-grams are ordered last as hot; with it the threshold of hotness grows with the corpus.
HOT_TABLE = 8_000_000
#: N-grams in more prefixes than this (or entries / HOT_TABLE, if more) are hot.
HOT_LEAST = 8
#: A hot n-gram's index list is dealt over lists of about this length.
LIST_ROWS = 50_000
#: Index entries of a task that forms lists.
PART_ROWS = 250_000
#: In lists up to this length every pair of entries decides which entries are skipped, in longer ones blocks do.
LIGHT = 64
#: Bytes of the sets of one family that are compared in one block, about.
BLOCK_BYTES = 16_000_000
#: Least and most bits of a remainder's sketch, and bits for each of its n-grams.
SKETCH_LEAST, SKETCH_MOST, SKETCH_RATE = 64, 4096, 16
#: Pairs of index entries that a task looks at together.
PAIRS_AT_ONCE = 2_000_000
#: Least and most log2 of the bits that mark the documents whose sets are fetched.
MARK_LEAST, MARK_MOST = 20, 30


def _sets(texts: list, k: int):
    """(index, sorted distinct n-gram hashes) of each text that has words."""
    c1, c2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    for a, b in chunks(texts):
        words, ids, counts = numbered_words(texts[a:b])
        w = word_hashes(words)[ids] if len(ids) else np.zeros(0, np.uint64)
        n = max(0, len(w) - k + 1)
        h = np.full(n, np.uint64(k))
        for j in range(k):
            h = (h ^ w[j : j + n]) * c1
            h ^= h >> np.uint64(29)
        h = h * c2
        h ^= h >> np.uint64(32)
        at = 0
        for i, m in enumerate(counts.tolist()):
            if m >= k:
                yield a + i, np.unique(h[at : at + m - k + 1])
            elif m:
                yield a + i, np.array([xxhash.xxh3_64_intdigest(w[at : at + m].tobytes(), seed=m)], np.uint64)
            at += m


def _class(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def _prefix(n: int, percent: int) -> int:
    """So many first n-grams of two sets that link can't all be different."""
    return n - (percent * n + 99) // 100 + 1


def _need(percent: int, n, m):
    """The overlap that sets of n and m elements need to link."""
    return -(-percent * (n + m) // (100 + percent))


def _short(s: np.ndarray) -> np.ndarray:
    """N-grams are counted, and told hot, by the upper half of their hashes."""
    return (s >> np.uint64(32)).astype(np.uint32)


def _profile(k: int, percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("prefix", pa.binary())])

    def run(batches):
        for rb in batches:
            ids, texts = rb.column("doc_id").to_pylist(), rb.column("text").to_pylist()
            rows = {"n": [0] * len(ids), "cls": [0] * len(ids), "prefix": [b""] * len(ids)}
            for i, s in _sets(texts, k):
                rows["n"][i], rows["cls"][i] = len(s), _class(s)
                rows["prefix"][i] = _short(s[: _prefix(len(s), percent)]).tobytes()
            yield batch(schema, doc_id=ids, **rows)

    return run, "doc_id long, n long, cls long, prefix binary"


def _token_counts(batches):
    schema = pa.schema([("token", pa.int64()), ("c", pa.int64())])
    for rb in batches:
        once = {(c, n): p for c, n, p in zip(rb.column("cls").to_pylist(), rb.column("n").to_pylist(), rb.column("prefix").to_pylist())}
        if all_tokens := b"".join(once.values()):
            token, c = np.unique(np.frombuffer(all_tokens, np.uint32), return_counts=True)
            yield batch(schema, token=token.astype(np.int64), c=c.astype(np.int64))


def _ordered(s: np.ndarray, p: int, hot: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's first p n-grams, hot ones last, and over how many lists each is dealt."""
    if not len(hot):
        return s[:p], np.ones(p, np.int64)
    key = _short(s)
    at = np.searchsorted(hot, key)
    at[at == len(hot)] = 0
    is_hot = hot[at] == key
    order = np.argsort(is_hot, kind="stable")[:p]
    return s[order], np.where(is_hot, many[at], 1)[order]


def _entries(k: int, percent: int, hot, salts):
    """Index entries of each set's prefix; a set that a task meets again is entered once."""
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches):
        seen = set()
        last, many = hot.value, salts.value
        for rb in batches:
            out = {f.name: [] for f in schema}
            for _, s in _sets(rb.column("text").to_pylist(), k):
                cls, n = _class(s), len(s)
                if (cls, n) in seen:
                    continue
                seen.add((cls, n))
                s, lists = _ordered(s, _prefix(n, percent), last, many)
                p = len(s)
                out["token"].append(s.view(np.int64))
                # salted lists have a salt of 1 or more
                out["salt"].append(np.where(lists > 1, cls % lists + 1, 0).astype(np.int32))
                out["cls"].append(np.full(p, cls, np.int64))
                out["n"].append(np.full(p, n, np.int32))
                out["pos"].append(np.arange(p, dtype=np.int32))
            if out["token"]:
                yield batch(schema, **{c: np.concatenate(v) for c, v in out.items()})

    return run, "token long, salt int, cls long, n int, pos int"


def _able(n: np.ndarray, reach: np.ndarray, percent: int) -> np.ndarray:
    """Which entries of one list, sorted by size, may be the first n-gram shared with another entry; reach: n-grams from the entry on."""
    if len(n) <= LIGHT:
        need = _need(percent, n[:, None], n[None, :])
        pair = (np.minimum.outer(n, n) * 100 >= percent * np.maximum.outer(n, n)) & (np.minimum.outer(reach, reach) >= need)
        np.fill_diagonal(pair, False)
        return pair.any(1)
    # the smallest partner asks for the least
    least = n[np.searchsorted(n, -(-percent * n // 100))]
    return reach >= _need(percent, n, least)


def _relations(percent: int):
    """Pairs (u, v) that join the sets of each index list to families, without the entries that position and size skip."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        got = [rb for rb in batches if rb.num_rows]
        if not got:
            return
        token, salt, cls, n, pos = (np.concatenate([rb.column(c).to_numpy(zero_copy_only=False) for rb in got]) for c in ("token", "salt", "cls", "n", "pos"))
        del got
        order = np.lexsort((cls, n, salt, token))
        token, salt, cls, n, pos = (x[order] for x in (token, salt, cls, n.astype(np.int64), pos.astype(np.int64)))
        same = lambda *cols: np.concatenate(([False], np.logical_and.reduce([c[1:] == c[:-1] for c in cols])))
        new = ~same(token, salt, cls, n)
        token, salt, cls, n, reach = (x[new] for x in (token, salt, cls, n, n - pos))
        starts = np.flatnonzero(~same(token, salt))
        sizes = np.diff(np.append(starts, len(token)))
        keep = np.repeat((salt[starts] > 0), sizes)  # the other parts of a salted list hold partners too
        # lists of two, all at once
        two = starts[(sizes == 2) & (salt[starts] == 0)]
        ok = (n[two] * 100 >= percent * n[two + 1]) & (np.minimum(reach[two], reach[two + 1]) >= _need(percent, n[two], n[two + 1]))
        keep[two[ok]] = keep[two[ok] + 1] = True
        for at in np.flatnonzero((sizes > 2) & (salt[starts] == 0)).tolist():
            a, b = starts[at], starts[at] + sizes[at]
            keep[a:b] = _able(n[a:b], reach[a:b], percent)
        token, salt, cls, n = (x[keep] for x in (token, salt, cls, n))
        # runs of neighbours by size in a list (sets between two that may link are each as near in size); the first of a run stands for it
        follows = same(token, salt) & np.concatenate(([False], n[:-1] * 100 >= percent * n[1:])) if len(token) else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(token))))
        u, v = [cls[follows]], [cls[first[follows]]]
        # parts of a salted list meet at a node of the n-gram's own
        heads = np.flatnonzero(~follows & (salt > 0))
        u.append(cls[heads])
        v.append(token[heads] ^ np.int64(0x5851F42D4C957F2D))
        pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1)
        yield batch(schema, u=pairs[0], v=pairs[1])

    return run, "u long, v long"


def _fetched(k: int, marks):
    """Whole sets of the documents that are marked (and of a few that share a mark)."""
    schema = pa.schema([("cls", pa.int64()), ("grams", pa.binary())])

    def run(batches):
        held = np.frombuffer(marks.value, np.uint8)
        for rb in batches:
            h = rb.column("mark").to_numpy()
            at = np.flatnonzero((held[h >> 3] >> (h & 7).astype(np.uint8)) & 1)
            if len(at):
                texts = rb.column("text").to_pylist()
                found = [s for _, s in _sets([texts[i] for i in at.tolist()], k)]
                yield batch(schema, cls=[_class(s) for s in found], grams=[s.tobytes() for s in found])

    return run, "cls long, grams binary"


def _marks(ids: DataFrame, bits: int) -> bytes:
    """2**bits bits, set at the hashes of ids."""
    h = ids.select(F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("h"))
    parts = h.groupBy(F.expr("bitmap_bucket_number(h + 1)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h + 1))").alias("bits"))
    out = bytearray(1 << (bits - 3))
    for r in parts.toLocalIterator():
        at = (r.part - 1) * 4096
        out[at : at + 4096] = r.bits
    return bytes(out)


def links_of(cls: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Places (i, j) of sets that link, enough of them to join all that link."""
    x = sets[0]
    n = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    at = np.searchsorted(x, flat)
    at[at == len(x)] = 0
    hit = x[at] == flat
    words = -(-len(x) // 64)
    mask = np.zeros((len(sets), words * 64), bool)
    mask[owner[hit], at[hit]] = True
    mask = np.packbits(mask, axis=1, bitorder="little").view(np.uint64)
    shared = np.bincount(owner[hit], minlength=len(sets))
    beyond = n - shared
    ends = np.cumsum(beyond)
    rest, rest_owner = flat[~hit], owner[~hit]
    remainder = [rest[e - m : e] for e, m in zip(ends.tolist(), beyond.tolist())]
    del flat, owner, at, hit
    bits = 1 << int(max(SKETCH_LEAST, min(SKETCH_MOST, SKETCH_RATE * int(beyond.max()))) - 1).bit_length()
    sketch = np.empty((len(sets), bits // 64), np.uint64)
    for a in range(0, len(sets), 256):
        b = min(len(sets), a + 256)
        part = slice(ends[a] - beyond[a], ends[b - 1])
        place = (rest_owner[part] - a) * bits + (rest[part] & np.uint64(bits - 1)).astype(np.int64)
        odd = (np.bincount(place, minlength=(b - a) * bits) & 1).astype(np.uint8).reshape(b - a, bits)
        sketch[a:b] = np.packbits(odd, axis=1, bitorder="little").view(np.uint64)

    root = np.arange(len(sets))
    out = []

    def join(i: int, j: int) -> None:
        out.append((i, j))
        root[root == root[j]] = root[i]

    # X's own answers
    for j in np.flatnonzero(100 * shared >= percent * (n + len(x) - shared)).tolist():
        if root[j] != root[0]:
            join(0, j)
    for i in range(len(sets)):
        other = root != root[i]
        other[: i + 1] = False
        left = np.flatnonzero(other)
        left = left[np.minimum(n[left], n[i]) * 100 >= percent * np.maximum(n[left], n[i])]
        if not len(left):
            continue
        # what must come from the remainders: none, at most what they have, at most what sketches allow
        more = _need(percent, n[left], n[i]) - np.bitwise_count(mask[left] & mask[i]).sum(1, dtype=np.int64)
        good = more <= np.minimum(beyond[left], beyond[i])
        left, more = left[good], more[good]
        open_ = more > 0
        if open_.any():
            differ = np.bitwise_count(sketch[left[open_]] ^ sketch[i]).sum(1, dtype=np.int64)
            good = np.ones(len(left), bool)
            good[open_] = 2 * more[open_] <= beyond[left[open_]] + beyond[i] - differ
            left, more = left[good], more[good]
        for j, m in sorted(zip(left.tolist(), more.tolist()), key=lambda p: p[1]):
            if root[j] != root[i] and (m <= 0 or len(np.intersect1d(remainder[i], remainder[j], assume_unique=True)) >= m):
                join(i, j)
    return out


def _compared(percent: int, by: tuple[str, ...]):
    """(u, v) of each set that links join to a smaller one, the smallest of its component, within each group of rows that agree in `by`; rows come sorted by these."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def linked(group: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(group)
        cls = t.column("cls").to_numpy()
        # a set that several documents gave is there once
        once = np.unique(cls, return_index=True)[1]
        once = once[np.argsort(t.column("n").to_numpy()[once], kind="stable")]
        grams = t.column("grams").to_pylist()
        sets = [np.frombuffer(grams[i], np.uint64) for i in once.tolist()]
        found = links_of(cls[once], sets, percent) if len(sets) > 1 else []
        least = {}

        def root(i: int) -> int:
            while i in least:
                i = least[i]
            return i

        for i, j in found:
            a, b = root(int(cls[once[i]])), root(int(cls[once[j]]))
            if a != b:
                least[max(a, b)] = min(a, b)
        return batch(schema, u=list(least), v=[root(i) for i in least])

    def run(batches):
        held, key = [], None
        for rb in batches:
            if not rb.num_rows:
                continue
            t = pa.Table.from_batches([rb])
            cols = [rb.column(c).to_numpy() for c in by]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), rb.num_rows]):
                now = tuple(int(c[a]) for c in cols)
                if held and now != key:
                    yield linked(held)
                    held = []
                held.append(t.slice(a, b - a))
                key = now
        if held:
            yield linked(held)

    return run, "u long, v long"


def _parity(s: np.ndarray) -> bytes:
    """A parity sketch of a whole set; of about as many bits as it has n-grams."""
    bits = 1 << max(SKETCH_LEAST.bit_length() - 1, min(SKETCH_MOST.bit_length() - 1, (len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """N-grams in one of two sets but not in both, at least, by their sketches; the longer one is folded."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x))) ^ x).sum())


def _sketched(batches):
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
    for rb in batches:
        sketches = [_parity(np.frombuffer(g, np.uint64)) for g in rb.column("grams").to_pylist()]
        yield batch(schema, cls=rb.column("cls"), n=rb.column("n"), sketch=sketches)


def _set_entries(percent: int, hot, salts):
    """Index entries of sets (cls, n, grams, block). A list that is dealt over c parts is one list for each two parts, where only entries of different parts meet, and one for each part."""
    schema = pa.schema([("token", pa.int64()), ("part", pa.int64()), ("own", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("reach", pa.int64()), ("block", pa.int32())])

    def run(batches):
        last, many = hot.value, salts.value
        for rb in batches:
            out = {f.name: [np.zeros(0, np.int64)] for f in schema}
            for cls, g, block in zip(rb.column("cls").to_pylist(), rb.column("grams").to_pylist(), rb.column("block").to_pylist()):
                whole = np.frombuffer(g, np.uint64)
                s, lists = _ordered(whole, _prefix(len(whole), percent), last, many)
                at = np.repeat(np.arange(len(s)), lists)
                other = np.arange(len(at)) - np.repeat(np.cumsum(lists) - lists, lists)
                mine, c = cls % lists[at], lists[at]
                out["token"].append(s.view(np.int64)[at])
                out["part"].append(np.minimum(mine, other) * c + np.maximum(mine, other))
                out["own"].append(np.where(mine == other, -1, mine))
                out["reach"].append(len(whole) - at)
                for name, value in (("cls", cls), ("n", len(whole)), ("block", block)):
                    out[name].append(np.full(len(at), value, np.int64))
            yield batch(schema, **{c: np.concatenate(v) for c, v in out.items()})

    return run, "token long, part long, own long, cls long, n long, reach long, block int"


def _meeting(percent: int):
    """The entries, once each, that may meet one of another block in their list; sizes, places and blocks rule the others out."""
    names = ("token", "part", "own", "cls", "n", "reach", "block")

    def run(batches):
        got = [rb for rb in batches if rb.num_rows]
        if not got:
            return
        cols = [np.concatenate([rb.column(c).to_numpy(zero_copy_only=False) for rb in got]) for c in names]
        schema = got[0].schema
        del got
        token, part, _, cls, n = cols[:5]
        order = np.lexsort((cls, n, part, token))
        first = np.ones(len(order), bool)
        first[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (token, part, cls)])
        cols = [c[order[first]] for c in cols]
        token, part, _, _, n, reach, _ = cols
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])))
        number = np.cumsum(new)
        # one of the neighbours by size must be near enough
        near = ~new[1:] & (n[:-1] * 100 >= percent * n[1:])
        keep = np.concatenate(([False], near)) | np.concatenate((near, [False]))
        # the smallest partner asks for the least
        wide = int(n.max()) + 1
        least = n[np.searchsorted(number * wide + n, number * wide - (-percent * n // 100))]
        keep &= reach >= _need(percent, n, least)
        number, cols = number[keep], [c[keep] for c in cols]
        # what is left of a list must lie in several blocks
        starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))[: len(number)])
        block = cols[-1]
        mixed = np.minimum.reduceat(block, starts) != np.maximum.reduceat(block, starts) if len(starts) else np.zeros(0, bool)
        keep = np.repeat(mixed, np.diff(np.append(starts, len(number))))
        yield batch(schema, **{c: v[keep] for c, v in zip(names, cols)})

    return run, "token long, part long, own long, cls long, n long, reach long, block int"


def _met(percent: int, neighbours: bool):
    """Distinct pairs u < v of different blocks and labels that sizes and places in a list leave possible; of neighbours by size only, or all."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    names = ("token", "part", "own", "cls", "n", "reach", "block", "label")

    def run(batches):
        got = [rb for rb in batches if rb.num_rows]
        if not got:
            return
        cols = [np.concatenate([rb.column(c).to_numpy(zero_copy_only=False) for rb in got]) for c in names]
        del got
        token, part, _, cls, n = cols[:5]
        order = np.lexsort((cls, n, part, token))
        first = np.ones(len(order), bool)
        first[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (token, part, cls)])
        token, part, own, cls, n, reach, block, label = (c[order[first]] for c in cols)
        number = np.cumsum(np.concatenate(([False], (token[1:] != token[:-1]) | (part[1:] != part[:-1]))))
        wide, places = int(n.max()) + 1, np.arange(len(n))
        # sizes rise in a list, so the partners of an entry that are not smaller follow it
        ends = np.searchsorted(number * wide + n, number * wide + np.minimum(n * 100 // percent, wide - 1), side="right")
        many = np.minimum(ends - places - 1, 1) if neighbours else ends - places - 1
        total = np.concatenate(([0], np.cumsum(many)))
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS_AT_ONCE, side="right")) - 1)
            i = np.repeat(places[a:b], many[a:b])
            j = i + 1 + np.arange(len(i)) - np.repeat(total[a:b] - total[a], many[a:b])
            ok = (block[i] != block[j]) & (label[i] != label[j]) & ((own[i] < 0) | (own[i] != own[j]))
            i, j = i[ok], j[ok]
            ok = np.minimum(reach[i], reach[j]) >= _need(percent, n[i], n[j])
            i, j = cls[i[ok]], cls[j[ok]]
            pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)
            yield batch(schema, u=pairs[0], v=pairs[1])
            a = b

    return run, "u long, v long"


def _held_against(percent: int):
    """(u, v) of rows with the sizes and sketches of both sets whose sketches leave a link possible."""

    def run(batches):
        for rb in batches:
            n, m, a, b = (rb.column(c).to_pylist() for c in ("n_u", "n_v", "sketch_u", "sketch_v"))
            ok = [_differ(x, y) <= i + j - 2 * _need(percent, i, j) for i, j, x, y in zip(n, m, a, b)]
            yield rb.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run, "u long, v long"


def _sharing(percent: int):
    """(u, v) of rows with both sets that link."""

    def run(batches):
        for rb in batches:
            both = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(rb.column("grams_u").to_pylist(), rb.column("grams_v").to_pylist()))
            ok = [len(np.intersect1d(x, y, assume_unique=True)) >= _need(percent, len(x), len(y)) for x, y in both]
            yield rb.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run, "u long, v long"


def _between(sets: DataFrame, links: DataFrame, percent: int, hot, salts, held: list[DataFrame]) -> DataFrame:
    """links with those of sets (cls, n, grams, block) of different blocks, enough of them to join all that link.

    Neighbours in the lists come first, so that groups of near copies that lie in several blocks are joined by a few
    pairs; then all pairs of what is still apart.
    """
    run, schema = _set_entries(percent, hot, salts)
    entries = stored(sets.select("cls", "n", "grams", "block").mapInArrow(run, schema), "entries")
    sketches = stored(sets.select("cls", "n", "grams").mapInArrow(_sketched, "cls long, n long, sketch binary"), "sketches")
    held.append(sketches)
    least = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run, schema = _meeting(percent)
    every, entries = entries, stored(entries.repartition(max(least, entries.count() // PART_ROWS + 1), "token", "part").mapInArrow(run, schema), "entries")
    discard(every)
    held.append(entries)
    parts = max(least, entries.count() // PART_ROWS + 1)

    def joined(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
        for side in ("u", "v"):
            pairs = pairs.join(rows.select(F.col("cls").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
        return pairs.select("u", "v", *(f"{c}_{side}" for c in columns for side in ("u", "v")))

    for neighbours in (True, False):
        labelled = entries.join(components(links).withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("component", "cls")).drop("component")
        run, schema = _met(percent, neighbours)
        pairs = labelled.repartition(parts, "token", "part").mapInArrow(run, schema).distinct()
        run, schema = _held_against(percent)
        near = stored(joined(pairs, sketches, "n", "sketch").mapInArrow(run, schema).distinct(), "near")
        run, schema = _sharing(percent)
        asked = near.select(F.explode(F.array("u", "v")).alias("cls")).distinct()
        whole = sets.join(F.broadcast(asked), "cls", "left_semi") if near.count() <= SENT_SETS else sets
        more = stored(joined(near, whole, "grams").mapInArrow(run, schema).distinct(), "links")
        held += [near, more]
        links = links.union(more)
    return links


def _hot(profile: DataFrame, entries: int):
    """(hot n-grams, how many lists each is dealt over), sorted, at most HOT_TABLE of them."""
    counted = profile.where("n > 0").select("cls", "n", "prefix").mapInArrow(_token_counts, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    rows = counted.where(F.col("c") > max(HOT_LEAST, int(entries / HOT_TABLE))).toArrow()
    token = rows.column("token").to_numpy().astype(np.uint32)
    order = np.argsort(token)
    return token[order], (rows.column("c").to_numpy()[order] // LIST_ROWS + 1).astype(np.int64)


def _families(docs: DataFrame, entries: int, hot, salts, k: int, percent: int) -> DataFrame:
    """(node, component): the family of each set that is in one, by its class."""
    spark = docs.sparkSession
    run, schema = _entries(k, percent, hot, salts)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // PART_ROWS + 1)
    listed = docs.where("doc_id is not null").mapInArrow(run, schema).repartition(parts, "token", "salt")
    run, schema = _relations(percent)
    return components(listed.mapInArrow(run, schema))


def _gathered(docs: DataFrame, members: DataFrame, count: int, k: int):
    """(cls, grams, n, x, block) of the classes in members, and the broadcast that their documents are told by."""
    spark = docs.sparkSession
    bits = min(MARK_MOST, max(MARK_LEAST, (16 * count).bit_length()))
    marks = spark.sparkContext.broadcast(_marks(members.select(F.col("rep").alias("id")), bits))
    run, schema = _fetched(k, marks)
    found = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("mark")).mapInArrow(run, schema)
    places = members.select("cls", "n", "x", "block")
    return found.join(F.broadcast(places) if count <= SENT_SETS else places, "cls"), marks


def _labels(docs: DataFrame, classes: DataFrame, families: DataFrame, hot, salts, k: int, percent: int, held: list[DataFrame]) -> DataFrame:
    """(node, component) of each class that links join to another; a component's first class may be left out. Its stored tables join `held`."""
    spark = docs.sparkSession
    clean(spark)  # the index lists are done with
    members = classes.join(families.select(F.col("node").alias("cls"), F.col("component").alias("x")), "cls")
    size = members.groupBy("x").agg((F.sum("n") * 8 / BLOCK_BYTES).cast("int").alias("last"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = stored(members.join(size, "x").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("last") + 1).cast("int")), "members")
    held.append(members)
    known = members.agg(F.count("*").alias("c"), F.max("last").alias("last"), F.count_if(F.col("last") > 0).alias("large")).first()

    # sets go from their documents straight to the tasks that compare them; only those of large families are stored
    sets, marks = _gathered(docs, members, known.c, k)
    run, schema = _compared(percent, ("x", "block"))
    by = ("x", "block")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = stored(sets.select("cls", "n", "grams", *by).repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(run, schema), "links")
    held.append(links)
    marks.destroy()
    del sets
    clean(spark)
    if known.last:  # families of several blocks
        sets, marks = _gathered(docs, members.where("last > 0"), known.large, k)
        sets = stored(sets.select("cls", "n", "grams", "block"), "sets")
        held.append(sets)
        marks.destroy()
        return components(_between(sets, links, percent, hot, salts, held))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


def ngram_jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, held: list[DataFrame] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text; other columns are ignored).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case. A document's set holds its distinct k-word
    n-grams, its whole word sequence if it is shorter; null, empty and blank texts have the empty
    set, which links with nothing. Two documents link when 100 * |A & B| >= percent * |A | B|;
    component_id is the smallest doc_id that links reach. Repeated rows give a row each. A row with a
    null doc_id joins the component of an equal set that has an id, and has a null one otherwise.
    doc_id must name one text: rows with one doc_id but different texts are documents of their own
    here, which carry the same id. Extra columns are ignored. An empty table gives an empty result.
    held: a list that stored tables, which the result reads, are added to, to be discarded after it.
    """
    held = [] if held is None else held
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, schema = _profile(k, percent)
    profile = stored(docs.mapInArrow(run, schema), "profile")
    held.append(profile)
    classes = profile.where("n > 0 and doc_id is not null").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"))
    entries = int((profile.agg(F.sum(F.length("prefix"))).first()[0] or 0) / 4)
    hot, salts = map(docs.sparkSession.sparkContext.broadcast, _hot(profile, entries))
    labels = _labels(docs, classes, _families(docs, entries, hot, salts, k, percent), hot, salts, k, percent, held)
    hot.destroy()
    salts.destroy()

    joined = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n", "rep", F.coalesce("component", "cls").alias("root"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = joined.join(least, "root").select("cls", "n", "component_id")
    return profile.select("doc_id", "n", "cls").join(found, ["cls", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_component(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, in their own columns; of repeated rows all stay."""
    held: list[DataFrame] = []
    groups = ngram_jaccard_components(docs, k, percent, held).where("doc_id <> component_id").select(F.col("doc_id").alias("__tracewell_gone")).distinct()
    groups = stored(groups, "gone")
    for done in held:
        discard(done)
    clean(docs.sparkSession)
    if groups.count() <= SENT_IDS:  # then the texts need not be moved
        groups = F.broadcast(groups)
    return docs.join(groups, F.col("doc_id") == F.col("__tracewell_gone"), "left_anti")
