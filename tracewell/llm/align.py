"""Alignment of two tokenizers over the bytes that both cover, and counts of linked id pairs.

Elementary intervals: the ends of both token sequences, merged, cut a text into intervals, and each
lies in one token of either side, found by binary search. So each interval is one overlap. Where an
interval's end is the end of both its tokens a group closes. The texts of a chunk are laid end to end and go
through one such merge; as texts end with tokens of both sides, no group crosses two texts.

Neither tokenizer has a token that goes from a character other than white space into a space, and what either makes of the
text after such a place doesn't depend on what stands before it. So texts are cut there, and each distinct
part is encoded and merged once and kept.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tracewell.llm.bpe import byte_letters
from tracewell.llm.common import chunks, small_batches
from tracewell.storage import stored

#: Id pairs whose counts are sent to all tasks, at most: those above a share of all links; others are joined.
SENT_PAIRS = 1_000_000
#: Text handled at a time, in characters.
AT_ONCE = 1_000_000
#: Parts of texts that a worker keeps; beyond that, only those of the texts at hand. Longer ones than CACHE_CHARS are not kept.
CACHE_PARTS, CACHE_CHARS = 300_000, 200
SHIFT = 32


#: A place where texts are cut: before a space that follows something else than white space.
_INSIDE = re.compile(r"(?<=\S)(?= )")
_PARTS = re.compile(r"\s+\S*(?:[^\S ]\s*\S*)*(?:\s+\Z)?")  # what lies between them; white space at the end goes with the last part


class Coders:
    """Both tokenizers, and the bytes of their ids. a_file: the JSON of a byte-level BPE; b_file: a sentencepiece model."""

    def __init__(self, a_file: str, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_file)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_letters(), json.loads(a_file)
        added = {t["id"]: t["content"] for t in vocabulary["added_tokens"]}
        known = {i: added[i].encode() if i in added else bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [known.get(i, b"") for i in range(max(known) + 1)]
        self.b = SentencePieceProcessor(model_proto=b_file)
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b))
        # texts of ids with what may follow them in a listing: A ids , or | and B ids , or ;
        self.say_a = np.array([f"{i}{c}" for i in range(len(self.bytes_a)) for c in ",|"], object)
        self.say_b = np.array([f"{i}{c}" for i in range(len(self.bytes_b)) for c in ",;"], object)
        # whether texts may be cut before a space: the byte-level pattern splits there, and no piece or added token goes across
        plain_a = vocabulary.get("normalizer") is None and (vocabulary.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and vocabulary["pre_tokenizer"].get("use_regex", True) and not vocabulary["pre_tokenizer"].get("add_prefix_space")
        self.cuts = plain_a and all(t["special"] for t in vocabulary["added_tokens"]) and not any(_INSIDE.search(piece(i).replace("▁", " ")) for i in range(self.b.get_piece_size()))
        self.known: dict[str, tuple] = {}

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """(A ids, B ids) of each text with a space before it; none for empty texts, and where the joined bytes of either side differ from it."""
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        at = [i for i, t in enumerate(texts) if t]
        a = [x.ids for x in self.a.encode_batch_fast([" " + texts[i] for i in at], add_special_tokens=False)]
        b = self.b.encode([texts[i] for i in at], num_threads=1)
        whole = [(" " + texts[i]).encode() for i in at]
        sizes, joined = np.fromiter(map(len, whole), np.int64, len(whole)), b"".join(whole)
        same = lambda rows, lengths, known: np.array_equal(_sizes(rows, lengths), sizes) and b"".join(map(known.__getitem__, chain.from_iterable(rows))) == joined
        every = same(a, self.size_a, self.bytes_a) and same(b, self.size_b, self.bytes_b)
        for i, x, y, w in zip(at, a, b, whole):
            if every or (b"".join(map(self.bytes_b.__getitem__, y)) == w and b"".join(map(self.bytes_a.__getitem__, x)) == w):
                out[i] = x, y
        return out

    def merged(self, texts: list[str]) -> list[tuple]:
        """(tokens of A, of B, groups, listing, links packed as longs, A id * 2^32 + B id) of each text."""
        coded, many = self.encode(texts), len(texts)
        (a, n_a), (b, n_b) = _flat([x for x, _ in coded]), _flat([y for _, y in coded])
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends, own_a, own_b, closes = overlaps(ends_a, ends_b)
        text = np.repeat(np.arange(many), n_a)[own_a]
        n_groups = np.bincount(text[closes], minlength=many)
        # the listing: tokens by group, A before B, each with the sign that follows it
        shared = ends[closes]
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
        said = np.concatenate([self.say_a[2 * a + last(group_a)], self.say_b[2 * b + last(group_b)]])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        said, tokens = said[order].tolist(), np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
        links = ((a[own_a] << SHIFT) + b[own_b]).tobytes()
        at = (8 * np.concatenate(([0], np.cumsum(np.bincount(text, minlength=many))))).tolist()
        listing = ["".join(said[i:j])[:-1] for i, j in zip(tokens, tokens[1:])]
        return list(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), listing, [links[i:j] for i, j in zip(at, at[1:])]))

    def aligned(self, texts: list[str | None]) -> list[tuple]:
        """What `merged` gives, from the parts of the texts; a text with a part that isn't given back byte by byte is merged as a whole."""
        if not self.cuts:
            return self.merged(texts)
        known, parts = self.known, [_PARTS.findall(" " + t) if t else () for t in texts]
        here = set().union(*parts)
        if len(known) + len(here) > CACHE_PARTS:  # parts that these texts hold as well stay
            again = {p: known[p] for p in here if p in known}
            known.clear()
            known.update(again)
        new = [p for p in here if p not in known]
        # every part begins with a space, which `encode` puts there
        known.update(zip(new, self.merged([p[1:] for p in new])))
        out: list[tuple] = []
        whole = []
        for i, each in enumerate(parts):
            got = [known[p] for p in each]
            n_a, n_b, n_groups, listing, links = zip(*got) if got else ((), (), (), (), ())
            if not all(n_a):
                whole.append(i)
            out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(listing), b"".join(links)))
        for i, one in zip(whole, self.merged([texts[i] for i in whole])):
            out[i] = one
        for p in new:
            if len(p) > CACHE_CHARS:
                del known[p]
        return out


def coders(a_file: str, b_file: bytes) -> Coders:
    """Kept by the worker process from task to task."""
    kept = sys.__dict__.setdefault("_tracewell_align", {})
    key = hashlib.sha256(a_file.encode() + b_file).digest()
    if key not in kept:
        kept.clear()
        kept[key] = Coders(a_file, b_file)
    return kept[key]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, owner in A, owner in B, closes) of the elementary intervals between the ends of two tilings of one range."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, a, b, (ends_a[a] == ends) & (ends_b[b] == ends) if len(ends) else np.zeros(0, bool)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum())), counts


def _sizes(rows: list[list[int]], lengths: np.ndarray) -> np.ndarray:
    """For each row of ids their lengths added up."""
    ids, counts = _flat(rows)
    total = np.concatenate(([0], np.cumsum(lengths[ids])))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, alignment, pairs, times) of every whole text.

    alignment: the groups in order as `a1,a2|b1;a3|b2,b3` in decimal ids (`groups` reads it). pairs: the distinct id
    pairs (A id * 2^32 + B id) with overlapping tokens, rising; times: how many overlaps each has. Strings of
    special tokens inside texts are plain text. Null and empty texts, and texts that a tokenizer doesn't
    give back byte by byte, have no tokens: zeros, '' and empty lists. Rows come one to one, repeated ones
    each, null ids stay null, other columns are ignored, and an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, alignment string, pairs array<long>, times array<int>"
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "alignment", "pairs", "times"]

    def run(batches):
        both = coders(*files.value)
        for rb in batches:
            texts = rb.column("_text").to_pylist()
            for at, to in chunks(texts, AT_ONCE):
                many = to - at
                n_a, n_b, n_groups, listing, packed = zip(*both.aligned(texts[at:to]))
                links = np.frombuffer(b"".join(packed), np.int64)
                n_links = np.fromiter(map(len, packed), np.int64, many) // 8
                # distinct pairs of each text
                wide, most = len(both.bytes_b), len(both.bytes_a)
                key, times = np.unique((np.repeat(np.arange(many), n_links) * most + (links >> SHIFT)) * wide + (links & (1 << SHIFT) - 1), return_counts=True)
                rest, of_b = key // wide, key % wide
                pair = (rest % most << SHIFT) + of_b
                sizes = np.bincount(rest // most, minlength=many)
                yield pa.RecordBatch.from_arrays([
                    rb.column(id_col).slice(at, many), *(pa.array(n, pa.int64()) for n in (n_a, n_b, n_groups, n_links)),
                    pa.array(listing, pa.string()), _lists(pair, sizes, pa.int64()), _lists(times, sizes, pa.int32())], names=names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def groups(alignment: Column) -> Column:
    """An alignment as an array of structs of A ids and B ids (arrays of int), empty for ''."""
    ids = lambda s: F.split(s, ",").cast("array<int>")
    sides = lambda g: F.struct(ids(F.substring_index(g, "|", 1)).alias("a"), ids(F.substring_index(g, "|", -1)).alias("b"))
    return F.transform(F.filter(F.split(alignment, ";"), lambda g: g != ""), sides)


def expanded(aligned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, place, a, b, weight): the product of each group's two sides; the weights of a group add up to 1."""
    each = aligned.select(id_col, F.posexplode(groups(F.col("alignment"))).alias("place", "g"))
    sides = each.select(id_col, "place", (1.0 / (F.size("g.a") * F.size("g.b"))).alias("weight"), F.explode("g.a").alias("a"), F.col("g.b").alias("bs"))
    return sides.select(id_col, "place", "a", F.explode("bs").alias("b"), "weight")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n): how many rows hold each id pair linked."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return counts.select(F.shiftright("pair", SHIFT).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("b"), "n")


def with_counts(aligned: DataFrame, sent: int = SENT_PAIRS) -> DataFrame:
    """Rows of aligned (..., pairs, times) without these two columns, with n_best and count_sum over all their links.

    A pair's count: how many rows hold it. n_best: links whose count is the highest of all pairs of their A id;
    count_sum: the counts of the links added up. Counts above a share of all go to the tasks (`sent` pairs at
    most, as counts add up to a known sum); rarer pairs, none of which has more than that share of the rows
    of the join, meet theirs in a join.
    """
    spark = aligned.sparkSession
    rows = stored(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    out = [c for c in aligned.columns if c not in ("pairs", "times")]
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair_counts")
    best = counts.groupBy(F.shiftright("pair", SHIFT).cast("int").alias("a")).agg(F.max("n").alias("best"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-total // sent))
    often = counts.where(F.col("n") >= least).toArrow().sort_by("pair").combine_chunks()
    top = best.toArrow()  # at most as many rows as A has ids
    highest = np.zeros(max(top.column("a").to_pylist(), default=0) + 1, np.int64)
    highest[top.column("a").to_numpy()] = top.column("best").to_numpy()
    shared = spark.sparkContext.broadcast((often.column("pair").to_numpy(), often.column("n").to_numpy(), highest))

    def looked_up(rb):
        """For all pairs of a batch: their row, times, whether their count was sent, and the count."""
        pair, n, _ = shared.value
        lists = rb.column("pairs")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, times = lists.flatten().to_numpy(zero_copy_only=False), rb.column("times").flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1))
        known = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
        return np.repeat(np.arange(len(sizes)), sizes), flat, times, known, n[at] if len(pair) else np.zeros(len(flat), np.int64)

    def add(batches):
        for rb in batches:
            row, flat, times, known, n = looked_up(rb)
            is_best = known & (n == shared.value[2][flat >> SHIFT])
            summed = lambda v: pa.array(_sums(row, v, rb.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in [*out, "_row"]), summed(times * is_best), summed(times * n * known)], names=[*out, "_row", "n_best", "count_sum"])

    def rare(batches):
        for rb in batches:
            row, flat, times, known, _ = looked_up(rb)
            yield pa.RecordBatch.from_arrays([rb.column("_row").take(pa.array(row[~known])), pa.array(flat[~known]), pa.array(times[~known])], names=["_row", "pair", "times"])

    kinds = "".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}, " for c in out)
    done = rows.mapInArrow(add, f"{kinds}_row long, n_best long, count_sum long")
    if least == 1:
        return done.drop("_row")
    few = counts.where(F.col("n") < least).withColumn("a", F.shiftright("pair", SHIFT).cast("int")).join(F.broadcast(best), "a").select("pair", "n", "best")
    met = rows.select("_row", "pairs", "times").mapInArrow(rare, "_row long, pair long, times int").join(few, "pair")
    more = met.groupBy("_row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
    both = done.join(more, "_row", "left")
    return both.select(*out, (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("s", F.lit(0))).alias("count_sum"))


def _sums(row: np.ndarray, values: np.ndarray, many: int) -> np.ndarray:
    """Sums of long values by row, exact; rows rise."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.searchsorted(row, np.arange(many + 1))
    return total[ends[1:]] - total[ends[:-1]]
