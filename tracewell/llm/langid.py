"""Language identification by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of a fixed length. Filters of several widths run over a
window, each keeps its largest response (ReLU), and a softmax layer gives the languages'
probabilities. A filter of width w is w tables with a row for each byte. For inference, tables of
neighbouring bytes are summed beforehand to tables for byte pairs, which halves the look-ups.

The softmax only tells learned languages apart. `keep_identified` also tells whether a text is in one at
all, by byte trigrams alone: their shares in each language come from all labelled documents, and how
usual they are is held against a limit calibrated on all documents kept from that: they must pass in
their own language, and fail in the others and with their letters in random order.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import boxed, chunks, small_batches, unboxed
from tracewell.storage import shipped

#: Bytes in a window.
WINDOW = 128
WIDTHS = (2, 3, 4)
#: Filters of each width.
FILTERS = 16
#: Most labelled rows that the training reads, whole texts of them.
SAMPLE_ROWS = 4000
#: Mini-batches that the training takes, of STEP windows each, dealt from all windows of the sampled texts.
STEPS, RATE, STEP = 1500, 0.004, 128
#: Windows that run through the network at a time.
AT_ONCE = 1024
UNDECIDED = "und"
#: Buckets of byte trigrams, a power of two as bits.
TRIGRAM_BITS = 16
#: Bytes of text whose trigrams are held at a time.
TRIGRAM_BYTES = 250_000
#: Lengths in bytes, besides their own, at which kept documents calibrate; what a lost document of a learned language counts against a foreign one that passes.
CUTS, LOST = (40, 150), 10.0
#: Steps that such values are counted in, to one.
GRAIN = 1024
#: A-Z in lower case, digits as one, other ASCII as a space.
_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 for c in range(256))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (zero-padded at each text's end) of all texts, the text of each, and its length without padding."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // WINDOW)
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    starts = np.concatenate(([0], np.cumsum(counts)))
    for t, a in zip(texts, starts[:-1].tolist()):
        flat[a * WINDOW : a * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    length = np.minimum(WINDOW, sizes[owner] - (np.arange(len(owner)) - starts[owner]) * WINDOW)
    return flat.reshape(-1, WINDOW), owner, length


class Network:
    """tables[w][k]: the part that a byte at place k of a filter of width w adds to its response, 256 x FILTERS."""

    def __init__(self, langs: list[str], seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.langs = langs
        self.tables = {w: rnd.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.dense = rnd.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.offset = np.zeros(len(langs), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        """Adam over shuffled mini-batches; the largest response of a filter passes its gradient to its own bytes only."""
        rnd = np.random.default_rng(seed)
        params = [*(self.tables[w] for w in WIDTHS), self.bias, self.dense, self.offset]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        while step < STEPS and len(x):
            order = rnd.permutation(len(x))
            for a in range(0, min(len(x), (STEPS - step) * STEP), STEP):
                xb, yb = x[order[a : a + STEP]], y[order[a : a + STEP]]
                tops, places = [], []
                for w in WIDTHS:
                    r = sum(self.tables[w][k][xb[:, k : WINDOW - w + 1 + k]] for k in range(w))
                    places.append(r.argmax(1))
                    tops.append(r.max(1))
                h = np.concatenate(tops, 1) + self.bias
                act = np.maximum(h, 0)
                z = act @ self.dense + self.offset
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                back = (p @ self.dense.T) * (h > 0)
                grads = []
                for i, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.tables[w])
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        byte = np.take_along_axis(xb, places[i] + k, 1)
                        np.add.at(g[k], (byte, np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [back.sum(0), act.T @ p, p.sum(0)]
                step += 1
                for param, g, (m, v) in zip(params, grads, moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def compiled(self) -> dict:
        """Tables for pairs of bytes (first byte the high one)."""
        t = self.tables
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        return {w: [pair(t[w][k], t[w][k + 1]) if k + 1 < w else t[w][k] for k in range(0, w, 2)] for w in WIDTHS}

    def probabilities(self, x: np.ndarray, tables: dict) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)), np.float32)
        for a in range(0, len(x), AT_ONCE):
            b = x[a : a + AT_ONCE]
            two = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
            tops = []
            for w in WIDTHS:
                span = WINDOW - w + 1
                r = None
                for k, t in zip(range(0, w, 2), tables[w]):
                    part = t.take((two if len(t) > 256 else b)[:, k : k + span], axis=0)
                    r = part if r is None else np.add(r, part, out=r)
                tops.append(r.max(1))
            z = np.maximum(np.concatenate(tops, 1) + self.bias, 0) @ self.dense + self.offset
            p = np.exp(z - z.max(1, keepdims=True))
            out[a : a + AT_ONCE] = p / p.sum(1, keepdims=True)
        return out


class Usual:
    """Trigram shares of languages. table[l]: log share of each trigram in language l; limit[l]: what `of` must reach to be in it.

    counts[l]: how often each trigram bucket stands in the texts of language l.
    """

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.limit = np.full(len(langs), -np.inf)
        shares = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        self.table = np.log(shares)
        mean = (shares * self.table).sum(1, keepdims=True)
        self.spread = np.sqrt((shares * (self.table - mean) ** 2).sum(1))
        self.table = self.table.astype(np.float32)

    @staticmethod
    def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the trigrams of all texts, without runs of spaces, the text of each, and its place there."""
        b = np.frombuffer(b" " + b"  ".join(texts).translate(_PLAIN) + b" ", np.uint8)
        sizes = np.array([len(t) + 2 for t in texts])
        gap = b == 32
        at = np.flatnonzero(~((gap[:-2] & gap[1:-1]) | (gap[1:-1] & gap[2:])))
        code = (b[at].astype(np.uint32) << 16) | (b[at + 1].astype(np.uint32) << 8) | b[at + 2]
        owner = np.searchsorted(np.cumsum(sizes), at, "right")
        return (code * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS), owner, at - (np.cumsum(sizes) - sizes)[owner]

    def sums(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sums of its trigrams' log shares in every language, and how many trigrams it has."""
        n, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.table)))
        for a, b in chunks(texts, TRIGRAM_BYTES):
            ids, owner, _ = self.trigrams(texts[a:b])
            n[a:b] = np.bincount(owner, minlength=b - a)
            for k, shares in enumerate(self.table):
                total[a:b, k] = np.bincount(owner, shares[ids], minlength=b - a)
        return total, n

    def usualness(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        many = np.maximum(n, 1)[:, None]
        return np.where(n[:, None] > 0, total / many + self.spread / np.sqrt(many), -np.inf)

    def of(self, texts: list[bytes]) -> np.ndarray:
        """For each text and language the mean log share of the text's trigrams, and what chance may take from so many."""
        return self.usualness(*self.sums(texts))

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its language by all its trigrams, the mean over its trigrams of that language's probability in their window of the text, and whether it is usual there."""
        many = len(texts)
        total, n, inside = np.zeros((many, len(self.table))), np.zeros(many, np.int64), np.zeros((many, len(self.table)))
        for a, b in chunks(texts, TRIGRAM_BYTES):
            ids, owner, place = self.trigrams(texts[a:b])
            if not len(ids):
                continue
            first = (np.diff(owner, prepend=-1) != 0) | (np.diff(place // WINDOW, prepend=-1) != 0)
            window = np.cumsum(first) - 1
            sums = np.stack([np.bincount(window, shares[ids]) for shares in self.table], 1)
            size, text = np.bincount(window), owner[first]
            p = np.exp(sums - sums.max(1, keepdims=True))
            p *= (size / p.sum(1))[:, None]
            n[a:b] = np.bincount(owner, minlength=b - a)
            for k in range(len(self.table)):
                total[a:b, k] = np.bincount(text, sums[:, k], minlength=b - a)
                inside[a:b, k] = np.bincount(text, p[:, k], minlength=b - a)
        top, every = total.argmax(1), np.arange(many)
        return top, inside[every, top] / np.maximum(n, 1), self.usualness(total, n)[every, top] >= self.limit[top]

    def values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What `of` gives for texts at each length of CUTS and whole, and for them with their letters in random order, fixed by the text."""
        mixed = [np.random.default_rng(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))).permutation(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")).tobytes().decode("utf-32-le", "surrogatepass") for t in texts]
        cut = lambda ts: self.of([t.encode("utf-8", "surrogatepass")[:n] for n in (*CUTS, None) for t in ts])
        return cut(texts), cut(mixed)

    def calibrate(self, rows: pa.Table) -> None:
        """Set the limit of each language with the fewest errors over counts of values (k, step, good, bad), of its own texts and of foreign ones."""
        for k in range(len(self.limit)):
            mine = rows.filter(pc.equal(rows.column("k"), k)).sort_by("step")
            step, good, bad = (mine.column(c).to_numpy() for c in ("step", "good", "bad"))
            if not good.sum() or not bad.sum():
                continue
            # between neighbours of all values; of equally good limits the middle one
            at = np.concatenate(([step[0]], (step[1:] + step[:-1] + 1) / 2)) / GRAIN
            lost, passed = np.cumsum(good) - good, bad.sum() - np.cumsum(bad) + bad
            cost = LOST * lost / good.sum() + passed / bad.sum()
            best = at[cost <= cost.min() + 1e-12]
            self.limit[k] = best[len(best) // 2]


def sample(docs: DataFrame, label: str = "lang") -> list:
    """(y, h, text): whole texts of at most SAMPLE_ROWS labelled rows, chosen by a hash of id and text."""
    h = F.xxhash64(F.col("doc_id").cast("string"), "text")
    rows = docs.where(F.col(label).isNotNull() & (F.length("text") > 0))
    many = docs.where(F.col(label).isNotNull()).count()
    if many > 2 * SAMPLE_ROWS:  # the smallest hashes, and not many others, so that tasks send little to the driver
        rows = rows.where(h < int(-(2**63) + 2**64 * (1.5 * SAMPLE_ROWS / many)))
    rows = rows.select(F.col(label).cast("string").alias("y"), h.alias("h"), F.col("text").cast("string").alias("text"))
    rows = rows.orderBy("h", "y", "text").limit(SAMPLE_ROWS)
    return sorted(rows.collect(), key=lambda r: (r.h, r.y, r.text))


def train(docs: DataFrame, label: str = "lang") -> Network | None:
    """A network fitted on a sample of labelled rows; None without any."""
    return fitted(sample(docs, label))


def fitted(got: list) -> Network | None:
    if not got:
        return None
    langs = sorted({r.y for r in got})
    x, owner, length = windows([r.text.encode() for r in got])
    y = np.array([langs.index(r.y) for r in got])[owner]
    fair = (length >= WINDOW // 2) | (np.bincount(owner)[owner] == 1)
    net = Network(langs)
    net.train(x[fair], y[fair])
    return net


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select(F.col("lang").cast("string").alias("y"), F.col("text").cast("string").alias("text"))


def trigram_model(docs: DataFrame, kept: DataFrame) -> Usual | None:
    """The trigrams of all labelled rows of docs, with limits from all labelled rows of kept; None without any label.

    Tasks count in numpy, and their counts are summed by language and bucket; so are the values of the kept
    texts, in steps of 1 / GRAIN. So what reaches the driver is bounded by languages, buckets and steps.
    """
    small_batches(docs.sparkSession)
    rows = _labelled(docs)
    langs = sorted(r.y for r in rows.select("y").distinct().collect())
    if not langs:
        return None
    number = {y: k for k, y in enumerate(langs)}

    def count(batches):
        counts = np.zeros((len(langs), 1 << TRIGRAM_BITS), np.int64)
        for rb in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in rb.column("text").to_pylist()]
            y = np.array([number[v] for v in rb.column("y").to_pylist()], np.int64)
            for a, b in chunks(texts, TRIGRAM_BYTES):
                ids, owner, _ = Usual.trigrams(texts[a:b])
                counts += np.bincount((y[a:b][owner] << TRIGRAM_BITS) + ids, minlength=counts.size).reshape(counts.shape)
        k, bucket = np.nonzero(counts)
        for i in range(0, len(k), 1 << TRIGRAM_BITS):
            part = slice(i, i + (1 << TRIGRAM_BITS))
            yield pa.RecordBatch.from_arrays([pa.array(k[part], pa.int32()), pa.array(bucket[part], pa.int32()), pa.array(counts[k[part], bucket[part]])], names=["k", "bucket", "n"])

    got = rows.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), 1 << TRIGRAM_BITS))
    counts[got.column("k").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    model = Usual(langs, counts)
    shared = shipped(docs.sparkSession, model)

    def value(batches):
        held, found = shared(), Counter()
        for rb in batches:
            texts, y = rb.column("text").to_pylist(), np.array([number.get(v, -1) for v in rb.column("y").to_pylist()], np.int64)
            for a, b in chunks(texts, TRIGRAM_BYTES):
                own, mixed = held.values(texts[a:b])
                known = np.tile(y[a:b], len(CUTS) + 1)
                for k in range(len(langs)):
                    for good, v in ((1, own[known == k, k]), (0, own[(known != k) & (known >= 0), k]), (0, mixed[known >= 0, k])):
                        step, n = np.unique(np.floor(v[np.isfinite(v)] * GRAIN).astype(np.int64), return_counts=True)
                        for x, m in zip(step.tolist(), n.tolist()):
                            found[k, x, good] += m
        if found:
            k, step, good = zip(*found)
            n = np.array(list(found.values()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(step, pa.int64()), pa.array(n * good), pa.array(n * (1 - np.array(good)))], names=["k", "step", "good", "bad"])

    values = _labelled(kept).mapInArrow(value, "k int, step long, good long, bad long").groupBy("k", "step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    model.calibrate(values.toArrow())
    return model


def predict(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' columns `keep` with lang_pred and score, from column text alone.

    The score is the mean probability of the predicted language over all windows of the whole text,
    weighted by their lengths. Texts that are null or have no letter, and all texts if there was
    nothing to learn from, get `und` and 0. Rows come one to one, whatever is repeated or null.
    """
    small_batches(docs.sparkSession)
    shared = shipped(docs.sparkSession, (net, net.compiled()) if net else None)
    letter = regex.compile(r"\p{L}")

    def run(batches):
        held = shared()
        for rb in batches:
            texts = rb.column("text").to_pylist()
            langs, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
            for a, b in chunks(texts) if held else ():
                at = [i for i in range(a, b) if texts[i] and letter.search(texts[i])]
                if not at:
                    continue
                raw = [texts[i].encode("utf-8", "surrogatepass") for i in at]
                x, owner, length = windows(raw)
                p = held[0].probabilities(x, held[1]) * length[:, None]
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                p = np.add.reduceat(p, first, axis=0) / np.add.reduceat(length, first)[:, None]
                top = p.argmax(1)
                for i, row, best in zip(at, p, top):
                    langs[i], scores[i] = held[0].langs[best], float(min(1.0, row[best]))
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    source = docs if "text" in keep else docs.select(*keep, "text")
    return source.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{schema}lang_pred string, score double")


def fold(of: str = "doc_id"):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(of).cast("string")) % 5


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; rows with fold 0 are held out of the training.

    A null doc_id counts as held out. Columns other than doc_id, text and lang are ignored.
    """
    docs = docs.withColumn("held_out", F.coalesce(fold() == 0, F.lit(True)))
    net = train(docs.where(~F.col("held_out")))
    return predict(docs, net, ("doc_id", "held_out"))


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs in a learned language, decided with a score of `least` or more, in their own columns.

    Languages are told apart by the trigrams of all labelled documents outside fold 0; all those in fold 0
    calibrate what is usual. Without any there, unusual texts stay too. Rows come one to one, whatever is repeated or null.
    """
    model = trigram_model(docs.where(fold() != 0), docs.where(fold() == 0))
    shared = shipped(docs.sparkSession, model)
    letter = regex.compile(r"\p{L}")
    rows = boxed(docs, "text")

    def run(batches):
        held = shared()
        for rb in batches:
            texts = rb.column("text").to_pylist()
            at = [i for i, t in enumerate(texts) if held and t and letter.search(t)]
            if not at:
                continue
            _, score, usual = held.judge([texts[i].encode("utf-8", "surrogatepass") for i in at])
            yield rb.take(pa.array(np.array(at)[usual & (score >= least)], pa.int64()))

    return unboxed(rows.mapInArrow(run, rows.schema), docs, "text")
