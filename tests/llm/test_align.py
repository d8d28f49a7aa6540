import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.conftest import SF
from tests.llm.conftest import LONG
from tracewell.llm import align, queries
from tracewell.llm.bpe import byte_letters
from tracewell.llm.queries import TOKENIZERS

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


class Plain:
    """Tokens with their bytes, and overlaps by plain loops over token ranges."""

    def __init__(self):
        self.a, self.b, self.letters = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_letters()
        self.a.encode_special_tokens = True

    def tokens(self, text):
        if not text:
            return [], []
        enc = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.letters[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def aligned(self, text):
        """(A ids, B ids, groups, links as id pairs)."""
        a, b = self.tokens(text)
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, j = [], 0
        for i, s, e in spans[0]:
            while j and spans[1][j][1] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, x, y = [], 0, 0
        for end in both:
            g = [], []
            while x < len(a) and spans[0][x][2] <= end:
                g[0].append(spans[0][x][0])
                x += 1
            while y < len(b) and spans[1][y][2] <= end:
                g[1].append(spans[1][y][0])
                y += 1
            groups.append(g)
        return len(a), len(b), groups, links


def brute(texts):
    plain = Plain()
    each = [plain.aligned(t) for t in texts]
    count = Counter(p for *_, links in each for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for n_a, n_b, groups, links in each:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if n_a else ""))
    return out


def listed(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def test_query_equals_plain_loops_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text for r in docs])
    got = queries.op11_cross_tokenizer_alignment(spark, SF)
    assert listed(got) == sorted((r.doc_id, *w) for r, w in zip(docs, want))


@pytest.mark.parametrize("sent", [7, 100])
def test_rare_pairs_meet_their_counts_in_a_join(spark, sent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = align.align(docs, A, B).drop("alignment")
    few, all_ = align.with_counts(rows, sent), align.with_counts(rows)
    assert few.columns == all_.columns and listed(few) == listed(all_)


def test_odd_rows(spark, odd):
    more = [(20, "a <|endoftext|> <s> <unk> <0x0A> b"), (21, "ﬁn ▁ x　y\u0000z"), (22, " two  spaces \r\n\ttab "), (23, "naïve 👩‍👩‍👧 ÅÅ"), (23, "naïve 👩‍👩‍👧 ÅÅ"), (24, "x" * 5000)]
    docs = odd.select("doc_id", "text", F.lit(1).alias("pairs"), F.lit(2).alias("n_a")).union(spark.createDataFrame([(*r, 1, 2) for r in more], "doc_id long, text string, pairs int, n_a int"))
    rows = docs.collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows])))
    out = align.align(docs, A, B)
    got = align.with_counts(out.withColumn("d", F.when(F.col("n_a") > 0, F.sha2("alignment", 256)).otherwise("")).drop("alignment"), 50)
    assert listed(got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "d")) == want
    assert any(r[0] == 2 and r[1:6] == (0, 0, 0, 0, 0) and r[-1] == "" for r in want) and LONG in {r.text for r in rows}


def test_groups_expand_to_products_of_weight_one(spark):
    docs = spark.createDataFrame([(1, "tokenization of wörds"), (2, None)], "doc_id long, text string")
    rows = align.align(docs, A, B)
    n_a, n_b, groups, _ = Plain().aligned("tokenization of wörds")
    read = {r.doc_id: r.g for r in rows.select("doc_id", align.groups(F.col("alignment")).alias("g")).collect()}
    assert [(list(g.a), list(g.b)) for g in read[1]] == groups and read[2] == []
    pairs = align.expanded(rows).collect()
    assert sorted((r.place, r.a, r.b) for r in pairs) == sorted((i, x, y) for i, (p, q) in enumerate(groups) for x in p for y in q)
    assert sum(r.weight for r in pairs) == pytest.approx(len(groups))
    counts = {(r.a, r.b): r.n for r in align.pair_counts(rows).collect()}
    assert counts and set(counts.values()) == {1}


def test_empty_table(spark, none):
    rows = align.align(none, A, B)
    assert rows.count() == 0 and align.with_counts(rows).count() == 0


def test_intervals():
    ends, a, b, closes = align.overlaps(np.array([2, 5, 9]), np.array([3, 5, 6, 9]))
    assert ends.tolist() == [2, 3, 5, 6, 9] and a.tolist() == [0, 1, 1, 2, 2] and b.tolist() == [0, 0, 1, 2, 3] and closes.tolist() == [False, False, True, False, True]


def test_each_distinct_part_is_encoded_once():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        both = align.Coders(f.read(), g.read())
    rnd = np.random.default_rng(5)
    signs = [" ", "  ", "\n", "\t", "a", "the", "é", "'s", "1", "▁", "<|endoftext|>", " ", "　", "。", "̈", "\x00", "\x85", "ﬁ", "!", "\r", "<s>", "<0x0A>", "x" * 150]
    odd = [None, "", " ", LONG, "x" * 500, *("".join(signs[i] for i in rnd.integers(0, len(signs), n)) for n in rnd.integers(0, 15, 3000))]
    assert both.cuts
    whole, seen, encode = both.merged(odd), [], both.encode
    both.encode = lambda texts: seen.extend(texts) or encode(texts)
    assert both.aligned(odd) == whole and both.aligned(odd) == whole
    seen.clear()
    assert both.aligned([LONG, LONG + "and"]) and sum(map(len, seen)) < 100
