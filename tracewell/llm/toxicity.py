"""Toxic spans by a linear-chain conditional random field, and scores of documents from its marginals.

Labels stand with documents, so tokens get theirs by evidence: a stem (a word, or a beginning of one)
that labelled toxic documents hold far more often than clean ones marks its words in the toxic
documents. In clean documents no token is toxic, whatever its stem. A chain of two tags over hashed
features of each word learns these labels by the gradient of its likelihood, in batches of windows.
Forward-backward gives each token of a whole text its probability of being toxic; the probabilities' sum,
their share of the text and their largest are what a logistic function turns into the document's
score, and tokens of a half or more are the offending spans.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import Numbered, chunks, small_batches
from tracewell.storage import shipped, stored

#: Most labelled rows that the model learns from, and windows of them (of WINDOW tokens) that the chain is trained on.
SAMPLE_ROWS, SAMPLE_WINDOWS, WINDOW = 4000, 9000, 48
#: Buckets that features are hashed to, and features of a word.
BUCKETS, FEATURES = 1 << 16, 8
#: A stem is evidence if toxic documents hold it this many times as often, by counts of which a document adds CAP at most.
LIFT, CAP, LEAST = 6.0, 3, 6.0
EPOCHS, RATE, DECAY, BATCH = 6, 0.1, 1e-5, 1024
#: Words whose features a worker keeps.
KEPT_WORDS = 200_000
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»¿¡“”„‘’…—–"
_WORD = re.compile(r"\S+")


def core(word: str) -> str:
    """A word in lower case without punctuation at its ends."""
    return word.strip(_EDGE).lower()


def stems(word: str) -> list[str]:
    """The word itself, and its beginnings of 4 to 6 letters."""
    return [f"={word}", *(f"<{word[:n]}" for n in (4, 5, 6) if len(word) > n)] if len(word) > 2 else []


def features(word: str) -> list[int]:
    """FEATURES buckets of a word: itself, beginnings, ends, and its form."""
    w = core(word)
    form = f"{word.isupper():d}{word != word.strip(_EDGE):d}{any(c.isdigit() for c in word):d}{min(len(w), 12)}"
    parts = [f"={w}", f"<{w[:3]}", f"<{w[:4]}", f"<{w[:5]}", f"<{w[:6]}", f">{w[-3:]}", f">{w[-4:]}", f"#{form}"]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for p in parts]


class Chain:
    """Weights of tag 1 against tag 0 by feature, of tags after tags, and of a text's first tag."""

    def __init__(self):
        self.words = np.zeros(BUCKETS)
        self.steps = np.zeros((2, 2))
        self.start = np.zeros(2)
        self.document = np.array([-4.0, 1.0, 0.0, 0.0])

    def train(self, feature: np.ndarray, tag: np.ndarray, size: np.ndarray) -> list[float]:
        """Adam on the likelihood of windows (feature: windows x tokens x FEATURES; size: tokens of each); the mean loss of each epoch."""
        rnd, losses, step = np.random.default_rng(13), [], 0
        params = [self.words, self.steps, self.start]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for _ in range(EPOCHS):
            order, total = rnd.permutation(len(tag)), 0.0
            for a in range(0, len(order), BATCH):
                at = order[a : a + BATCH]
                loss, grads = self.gradient(feature[at], tag[at], size[at])
                total += loss
                step += 1
                for p, g, (m, v) in zip(params, grads, moments):
                    g = g / len(at) + DECAY * p
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            losses.append(total / max(1, len(tag)))
        return losses

    def gradient(self, feature: np.ndarray, tag: np.ndarray, size: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """(negative log likelihood, its gradients) of windows: expected counts of features and steps less those of the labels."""
        many, long = tag.shape
        here = np.arange(long)[None, :] < size[:, None]
        e = np.where(here, self.words[feature].sum(2), 0.0)
        e = np.stack([np.zeros_like(e), e], 2)
        step = np.where(here[:, 1:, None, None], self.steps, 0.0)  # beyond the end all tags weigh the same
        up = np.zeros((many, long, 2))
        up[:, 0] = self.start + e[:, 0]
        for t in range(1, long):
            up[:, t] = np.logaddexp.reduce(up[:, t - 1, :, None] + step[:, t - 1], 1) + e[:, t]
        down = np.zeros((many, long, 2))
        for t in range(long - 1, 0, -1):
            down[:, t - 1] = np.logaddexp.reduce(step[:, t - 1] + (e[:, t] + down[:, t])[:, None, :], 2)
        whole = np.logaddexp.reduce(up[:, -1], 1)
        p = np.exp(up + down - whole[:, None, None])
        pair = np.exp(up[:, :-1, :, None] + step + (e[:, 1:] + down[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        pair *= here[:, 1:, None, None]
        row, at = np.nonzero(here)
        told = np.take_along_axis(e, tag[:, :, None], 2)[:, :, 0].sum() + self.start[tag[:, 0]].sum()
        r2, a2 = np.nonzero(here[:, 1:])
        told += self.steps[tag[r2, a2], tag[r2, a2 + 1]].sum()
        off = p[row, at, 1] - tag[row, at]
        words = np.bincount(feature[row, at].reshape(-1), np.repeat(off, feature.shape[2]), BUCKETS)
        steps = pair.sum((0, 1))
        np.subtract.at(steps, (tag[r2, a2], tag[r2, a2 + 1]), 1)
        start = p[:, 0].sum(0) - np.bincount(tag[:, 0], minlength=2)
        return float(whole.sum() - told), [words, steps, start]

    def marginals(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of tag 1 of tokens in a row with word weights e; `first` marks those that begin a text.

        The row is cut into as many pieces as each has tokens (about). All pieces multiply their steps' matrices
        at once, then the pieces' products hand the sides' weights on, and all pieces go through their tokens.
        """
        n = len(e)
        if not n:
            return np.zeros(0)
        long = max(1, int(np.sqrt(n)))
        many = -(-n // long)
        m = np.empty((many * long, 2, 2))  # m[t]: weights of (tag before, tag)
        m[n:] = np.eye(2)
        top = np.maximum(e, 0)
        m[:n] = np.exp(self.steps - self.steps.max())[None]
        m[:n][first] = np.exp(self.start - self.start.max())[None, None, :]
        m[:n, :, 1] *= np.exp(e - top)[:, None]
        m[:n, :, 0] *= np.exp(-top)[:, None]
        m = np.ascontiguousarray(m.reshape(many, long, 2, 2).swapaxes(0, 1))
        whole = np.broadcast_to(np.eye(2), (many, 2, 2))
        for t in range(long):
            whole = whole @ m[t]
            whole = whole / whole.sum((1, 2), keepdims=True)
        left, right = np.ones((many, 2)), np.ones((many, 2))
        for i in range(1, many):
            v = left[i - 1] @ whole[i - 1]
            left[i] = v / v.sum()
            v = whole[many - i] @ right[many - i]
            right[many - 1 - i] = v / v.sum()
        ups = np.empty((long, many, 2))
        v = left[:, None, :]
        for t in range(long):
            v = v @ m[t]
            v = v / v.sum(2, keepdims=True)
            ups[t] = v[:, 0]
        v = right[:, :, None]
        out = np.empty((long, many))
        for t in range(long - 1, -1, -1):
            p = ups[t] * v[:, :, 0]
            out[t] = p[:, 1] / p.sum(1)
            v = m[t] @ v
            v = v / v.sum(1, keepdims=True)
        return out.T.reshape(-1)[:n]

    def score(self, sums: np.ndarray) -> np.ndarray:
        """Scores of documents from their rows (probabilities' sum, largest, tokens)."""
        return 1 / (1 + np.exp(-np.clip(summary(sums) @ self.document, -30, 30)))

    def calibrate(self, sums: np.ndarray, toxic: np.ndarray) -> None:
        """The logistic function of documents' sums, by Newton steps with a little decay."""
        x, w = summary(sums), np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - toxic) + 0.1 * w
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4), g)
        self.document = w


def summary(sums: np.ndarray) -> np.ndarray:
    """A constant, and the probabilities' sum, their share of all tokens, and the largest, of each document."""
    total, most, n = sums.T
    return np.stack([np.ones(len(sums)), np.log1p(total), np.log(1e-3 + total / np.maximum(n, 1)) + 7, most], 1)


class Reader:
    """Turns texts into word weights of a chain; keeps the words that it has seen."""

    def __init__(self, chain: Chain):
        self.chain, self.known = chain, {}

    def weights(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known = {}
            new = words
        if new:
            rows = np.array(list(map(features, new)))
            self.known.update(zip(new, self.chain.words[rows].sum(1).tolist()))
        out = np.fromiter(map(self.known.__getitem__, words), float, len(words))
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        return out

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums of each text, marginals of all tokens in a row, tokens of each text)."""
        seen, ids, counts = Numbered(), [], np.zeros(len(texts), np.int64)
        get = seen.__getitem__
        for i, t in enumerate(texts):
            w = t.split() if t else ()
            counts[i] = len(w)
            ids.extend(map(get, w))
        e = self.weights(list(seen))[np.array(ids, np.int64)] if ids else np.zeros(0)
        begins = np.cumsum(counts) - counts
        first = np.zeros(len(e), bool)
        first[begins[counts > 0]] = True
        p = self.chain.marginals(e, first)
        total, most = np.zeros(len(texts)), np.zeros(len(texts))
        if len(p):
            total[counts > 0], most[counts > 0] = np.add.reduceat(p, begins[counts > 0]), np.maximum.reduceat(p, begins[counts > 0])
        return np.stack([total, most, counts], 1), p, counts


def fold(of: str = "doc_id"):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(of).cast("string")) % 5


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic, text) of at most `most` labelled ids, chosen by a hash; of conflicting labels the smallest counts, and of an id's texts too."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    texts = docs.where("doc_id is not null and text is not null")
    chosen = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return texts.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def evidence(rows: DataFrame) -> set[str]:
    """Stems of the sample (toxic, text) that toxic documents hold far more often."""

    def run(batches):
        told: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for rb in batches:
            for toxic, text in zip(rb.column("toxic").to_pylist(), rb.column("text").to_pylist()):
                for stem, n in Counter(s for w in text.split() for s in stems(core(w))).items():
                    told[toxic][stem] += min(n, CAP)
        for toxic, counts in told.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([toxic] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["stem", "toxic", "n"])

    docs = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not docs.get(0) or not docs.get(1):
        return set()
    n = lambda k: F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0))
    counts = rows.select("toxic", "text").mapInArrow(run, "stem string, toxic int, n long").groupBy("stem").agg(n(1).alias("t"), n(0).alias("c"))
    lift = F.col("t") / docs[1] / ((F.col("c") + 0.5) / docs[0])
    return {r.stem for r in counts.where((F.col("t") >= LEAST) & (lift >= LIFT)).select("stem").collect()}


def windows(rows: DataFrame, known: set[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, tags, sizes) of at most SAMPLE_WINDOWS windows of the sample: by hash, three quarters from those with a stem of evidence."""
    shared = shipped(rows.sparkSession, known)

    def run(batches):
        held = shared()
        seen: dict[str, tuple[list[int], bool]] = {}
        for rb in batches:
            for id_, toxic, text in zip(*(rb.column(c).to_pylist() for c in ("doc_id", "toxic", "text"))):
                words = text.split()
                for a in range(0, len(words), WINDOW):
                    got = []
                    for w in words[a : a + WINDOW]:
                        if w not in seen:
                            if len(seen) > KEPT_WORDS:
                                seen.clear()
                            seen[w] = features(w), any(s in held for s in stems(core(w)))
                        got.append(seen[w])
                    marked = [m for _, m in got]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([any(marked)]), pa.array([f"{id_}:{a}"]), pa.array([[i for f, _ in got for i in f]], pa.list_(pa.int32())),
                        pa.array([[int(m and toxic) for m in marked]], pa.list_(pa.int32()))], names=["marked", "name", "feature", "tag"])

    cut = stored(rows.mapInArrow(run, "marked boolean, name string, feature array<int>, tag array<int>"), "windows")
    best = lambda kind, most: cut.where(F.col("marked") == kind).orderBy(F.xxhash64("name"), "name").limit(most)
    got = best(True, SAMPLE_WINDOWS * 3 // 4).union(best(False, SAMPLE_WINDOWS // 4)).toArrow().sort_by("name")
    size = np.array([len(t) for t in got.column("tag").to_pylist()], np.int64)
    feature, tag = np.zeros((len(size), WINDOW, FEATURES), np.int32), np.zeros((len(size), WINDOW), np.int64)
    for i, (f, t) in enumerate(zip(got.column("feature").to_pylist(), got.column("tag").to_pylist())):
        feature[i, : size[i]], tag[i, : size[i]] = np.array(f).reshape(-1, FEATURES), t
    return feature, tag, size


def fit(docs: DataFrame, labels: DataFrame) -> Chain | None:
    """The chain learned from labelled documents; None unless both labels occur and some stem is evidence."""
    rows = stored(sample(docs, labels), "labelled").repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id")
    known = evidence(rows)
    if not known:
        return None
    chain = Chain()
    chain.train(*windows(rows, known))
    shared = shipped(docs.sparkSession, chain)

    def run(batches):
        reader = Reader(shared())
        for rb in batches:
            texts = rb.column("text").to_pylist()
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays([rb.column("doc_id").slice(a, b - a), rb.column("toxic").slice(a, b - a), pa.array(reader.read(texts[a:b])[0].tolist(), pa.list_(pa.float64()))], names=["doc_id", "toxic", "sums"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"doc_id {kind}, toxic int, sums array<double>").toArrow().sort_by("doc_id")
    chain.calibrate(np.array(got.column("sums").to_pylist()), got.column("toxic").to_numpy().astype(float))
    return chain


def score(docs: DataFrame, chain: Chain | None, keep: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """docs' columns `keep` with score and predicted, and with `spans` the offending tokens as array<struct<start, end, p>> (code points).

    Null and empty texts have the score of a text without tokens. Without a chain all scores are 0 and
    there are no spans. Rows come one to one, repeated ones each, null ids stay null.
    """
    small_batches(docs.sparkSession)
    shared = shipped(docs.sparkSession, chain)
    struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + "score double, predicted int" + (", spans array<struct<start:int,end:int,p:double>>" if spans else "")

    def found(text: str, p: np.ndarray) -> list[dict]:
        if not (p >= 0.5).any():
            return []
        return [{"start": m.start(), "end": m.end(), "p": float(x)} for m, x in zip(_WORD.finditer(text), p) if x >= 0.5]

    def run(batches):
        held = shared()
        reader = Reader(held) if held else None
        for rb in batches:
            texts = rb.column("_text").to_pylist()
            for a, b in chunks(texts):
                sums, p, counts = reader.read(texts[a:b]) if reader else (np.zeros((b - a, 3)), np.zeros(0), np.zeros(b - a, int))
                s = held.score(sums) if held else np.zeros(b - a)
                more = []
                if spans:
                    ends = np.cumsum(counts)
                    more = [pa.array([found(t or "", p[e - n : e]) for t, n, e in zip(texts[a:b], counts, ends)], struct)]
                yield pa.RecordBatch.from_arrays([*(rb.column(c).slice(a, b - a) for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), *more], names=[*keep, "score", "predicted", *(["spans"] if spans else [])])

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, spans: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text), with `spans` also the offending tokens.

    Rows with fold 0 are held out of the learning; a null doc_id counts as held out. Of labels only doc_id and
    toxic are read; rows with nulls or other values than 0 and 1, or of unknown documents, teach nothing.
    Empty tables of docs give an empty result; without labels of both kinds all scores are 0.
    """
    docs = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(docs, fit(docs.where(~F.col("held_out")), labels), ("doc_id", "held_out"), spans)
