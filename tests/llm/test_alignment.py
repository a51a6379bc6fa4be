"""Cross-tokenizer alignment against the libraries on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from voxlake.llm import alignment
from voxlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, pairs string, row_id string, block int, n_a string, place string"
TEXTS = [
    None, "", " ", "a", "Hello, WORLD! It's 12 o'clock...", " leading and  double   spaces ", "tab\tand\nline \n breaks\r\n\r\n", "日本語の文章。 ﬁne İstanbul ΣΑΣ é  \u0085\x1c end",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "sym▁bol makes no tokens", "😀😀 ​!!! ??? _ __ a_b", "x" * 3000, "naïve café " * 40, "def f(x):\n    return x  # 'quoted' 3.14\n" * 9,
]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def both():
    return alignment.pair(*alignment._definitions("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain(libraries, p, rows):
    """Results by row, from whole texts and a walk over all token pairs' byte ranges."""
    held, docs_of = [], Counter()
    for doc_id, text in rows:
        body = (" " + (text or "")).encode()
        a, b = (libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)) if text else ([], [])
        if b"".join(p.a.entries[i] for i in a) != body or b"".join(p.b.entries[i] for i in b) != body:
            a, b = [], []
        links, groups, i, j, at_a, at_b = [], [], 0, 0, 0, 0
        group: tuple = ([], [])
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                start, at_a = at_a, at_a + len(p.a.entries[a[i]])
                group[0].append(a[i])
                i += 1
            else:
                start, at_b = at_b, at_b + len(p.b.entries[b[j]])
                group[1].append(b[j])
                j += 1
            if group[0] and group[1] and start < min(at_a, at_b):
                links.append((group[0][-1], group[1][-1]))
            if at_a == at_b:
                groups.append(group)
                group = ([], [])
        held.append((doc_id, len(a), len(b), groups, links))
        docs_of.update(set(links))
    most: dict = defaultdict(int)
    for (a, _), n in docs_of.items():
        most[a] = max(most[a], n)
    out = []
    for doc_id, n_a, n_b, groups, links in held:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(docs_of[x] == most[x[0]] for x in links), sum(docs_of[x] for x in links), sha))
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1, "z", "w") for d, t in rows], SCHEMA).repartition(3)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_texts(spark, libraries, both):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], rows[12]]
    assert found(alignment.alignment(made(spark, rows))) == plain(libraries, both, rows)
    assert alignment.alignment(made(spark, rows).limit(0)).collect() == []


def test_long_texts_through_the_tree(spark, libraries, both, monkeypatch):
    monkeypatch.setattr(alignment, "SEGMENT", 300)
    monkeypatch.setattr(alignment, "RANGE", 37)
    monkeypatch.setattr(alignment, "PAIRS", 200)
    rnd = random.Random(2)
    words = [w for t in TEXTS if t and "▁" not in t for w in t.split(" ")] + ["résumé", "antidisestablishmentarianism", "0xdeadbeef"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([5, 60, 3000])))) for i in range(20)]
    rows += [(50, "q" * 2000), (51, rows[0][1] * 30 + " ▁")]
    assert any(len(t) > 3000 for _, t in rows)
    assert found(alignment.alignment(made(spark, rows))) == plain(libraries, both, rows)


def test_fragments_are_associative(both):
    rnd = random.Random(4)
    text = " ".join(rnd.choice(["internationalization", "naïve", "日本語", "a", "foo_bar", "x86-64"]) for _ in range(60))
    t = both.tokens([alignment.words_of(text)])[0]
    ends = [np.cumsum(s.length[x]) for s, x in ((both.a, t.a), (both.b, t.b))]
    for _ in range(20):
        stops = sorted({0, int(ends[0][-1]), *(rnd.randrange(int(ends[0][-1])) for _ in range(rnd.randrange(1, 40)))})
        parts = []
        for lo, hi in zip(stops, stops[1:], strict=False):
            (a0, a1), (b0, b1) = ((int(np.searchsorted(e, lo, "right")), int(np.searchsorted(e, hi, "right"))) for e in ends)
            parts.append(alignment.fragment(both, t.a[a0:a1], t.b[b0:b1], ends[0][a0:a1], ends[1][b0:b1]))
        left, right = parts[0], parts[-1]
        for f in parts[1:]:
            left = alignment.compose(both, left, f)
        for f in parts[-2::-1]:
            right = alignment.compose(both, f, right)
        one = alignment.whole(both, alignment.folded(both, [alignment.fragment(both, t.a, t.b, *ends)]))
        for f in (left, right, alignment.folded(both, parts)):
            got = alignment.whole(both, f)
            assert got[:2] == one[:2] and sorted(got[2].tolist()) == sorted(one[2].tolist())


def test_query_on_the_small_table(spark, libraries, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(QUERIES["op12_alignment"](spark, "/root/testdata/sf0.001")) == plain(libraries, both, rows)
