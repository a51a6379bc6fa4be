"""Repeated passages against a plain computation over all windows."""

import hashlib
import random
import re

import pytest

from voxlake.llm import substrings
from voxlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, tag string, class int, spans string, digest string, keep_id int"


def plain(rows, length):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    starts = lambda w: range(len(w) - length + 1)
    first: dict = {}
    for d, w in words:
        for i in starts(w):
            if d is not None:
                first[tuple(w[i : i + length])] = min(first.get(tuple(w[i : i + length]), d), d)
    out, spans = [], []
    for d, w in words:
        gone = [False] * len(w)
        for i in starts(w):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
        edges = [i for i in range(len(w) + 1) if (i < len(w) and gone[i]) != (i > 0 and gone[i - 1])]
        spans += [(d, a, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return sorted(out, key=str), sorted(set(spans))


def made(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "y", "z", 3) for d, t in rows], SCHEMA).repartition(3)


def corpus(seed, letters):
    rnd = random.Random(seed)
    base = [str(rnd.randrange(letters)) for _ in range(60)]
    rows = []
    for _ in range(120):
        at = rnd.randrange(40)
        passage = [x if rnd.random() > 0.05 else f"z{rnd.randrange(5)}" for x in base[at : at + rnd.randrange(30)]]
        rows.append((rnd.randrange(100), rnd.choice([" ", "\n\t"]).join([*(str(rnd.randrange(letters)) for _ in range(rnd.randrange(12))), *passage])))
    rows += [(500, " ".join(["0"] * 300)), (501, " ".join(["0"] * 200 + ["1"] + ["0"] * 100)), (502, None), (502, ""), (503, " \n "), (None, rows[0][1]), (None, rows[1][1])]
    return [*rows, rows[3], rows[3], rows[9]]


@pytest.mark.parametrize("seed,letters,length,heavy", [(1, 2, 6, 32_768), (2, 3, 7, 3), (3, 2, 8, 16)])
def test_equals_all_windows(spark, monkeypatch, seed, letters, length, heavy):
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    monkeypatch.setattr(substrings, "BLOCK", 64)
    rows = corpus(seed, letters)
    want, spans = plain(rows, length)
    docs = made(spark, rows)
    assert sorted((tuple(r) for r in substrings.without_repeats(docs, length).collect()), key=str) == want
    assert sorted({tuple(r)[:3] for r in substrings.repeats(docs, length).collect()}) == spans


def test_query_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op11_substring_dedup"](spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == plain([tuple(r) for r in docs.select("doc_id", "text").collect()], 50)[0]
    assert any(r[2] for r in got) and not all(r[2] for r in got)


def test_sources_hold_the_passage(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(9, f"a b {passage} c"), (4, f"{passage} d"), (6, f"e {passage}"), (5, " ".join(passage.split()[:49]))]
    found = {r["doc_id"]: (r["first_word"], r["last_word"], r["source"]) for r in substrings.repeats(made(spark, rows)).collect()}
    assert found == {9: (2, 61, 4), 6: (1, 60, 4)}


def test_long_texts_and_none(spark):
    long = " ".join(f"{i % 7919}-{i % 104729}" for i in range(300_000))
    got = {r["doc_id"]: r["n_removed"] for r in substrings.without_repeats(made(spark, [(1, long), (2, "x " + long + " y"), (3, long)])).collect()}
    assert got == {1: 0, 2: 300_000, 3: 300_000}
    assert substrings.without_repeats(made(spark, []).limit(0)).collect() == []
    assert substrings.repeats(made(spark, []).limit(0)).collect() == []
