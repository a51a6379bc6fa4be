"""Each operator against a plain computation, on odd rows and on the small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from voxlake.llm import bpe, exact, idfiles, licenses, neardup, packing, quality, shared, token_counts, topk, urls
from voxlake.llm.queries import QUERIES, SQL
from voxlake.llm.shared import ascii_lower, stored, tokenizer_json

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp int, size int, score string, row_id string, digest string, start string"
LONG = "The MIT License covers it. " * 3000 + "x" * 9000
TEXTS = [
    None, "", " \n\t", "a", "Hello, WORLD! It's 12 o'clock...", "hello, world! it's 12 O'CLOCK...", "Übung macht den Meister; ÜBUNG.", "übung", LONG, LONG,
    "<|endoftext|> and <|startoftext|>?", "日本語の文章。 ﬁne İstanbul ΣΑΣ e\u0301 \u00a0\u0085\x1c end", "apache license mit license gnu general public license",
    "Licensed under CC BY-NC 4.0.", "one two three", "one two three four five six seven eight nine ten", "One two three four five six seven eight nine TEN", "😀😀 \u200b!!! ??? _ __ a_b",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en", "s", 1, "x", 1, 2, "y", "r", "d", "s") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], rows[15]]
    return stored(spark.createDataFrame(rows, DOCS).repartition(3), "odd")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1 --------------------------------------------------------------------------


def plain_count(text, ranks):
    total = 0
    for piece in token_counts._any_text().findall(text):
        data, best = piece.encode(), [(0, 0)]
        for i in range(1, len(data) + 1):
            best.append(max((best[j][0] - round(token_counts.STEP * math.log(ranks[data[j:i]] + 2)), best[j][1] - 1) for j in range(max(0, i - 128), i) if data[j:i] in ranks))
        total -= best[-1][1]
    return total


def test_token_counts(spark, docs, none):
    import base64

    lines = tokenizer_json("byte_bpe_50k.tiktoken").splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
    counted = {}
    plain = lambda rows: sorted(((i, counted.setdefault(t, plain_count(t, ranks)) if t not in counted else counted[t], len(t.encode())) for i, t in rows), key=str)
    few = sf_docs(spark).where("n_chars < 3000")
    assert rows_of(token_counts.token_counts(few), "doc_id", "n_tokens", "n_bytes") == plain(pairs(few))
    assert rows_of(token_counts.token_counts(docs), "doc_id", "n_tokens", "n_bytes") == plain(pairs(docs))  # long texts, clashing names
    assert token_counts.token_counts(none).count() == 0


# 2 --------------------------------------------------------------------------


def test_quality_reaches_held_out_accuracy(spark):
    out = QUERIES["op2_quality"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = [(r["score"], r["quality"], r["predicted"]) for r in out.where("held_out").join(labels, "doc_id").collect()]
    good, bad = [s for s, q, _ in got if q], [s for s, q, _ in got if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([p == q for _, q, p in got]) > 0.97


def test_quality_cases(spark, docs, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    net = quality.train(docs, labels, quality.Training(least_steps=5, epochs=1))
    out = quality.judged(docs, net).collect()
    assert len(out) == len(TEXTS) + 3 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    kept = quality.keep_good(docs, net)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in out)
    untrained = quality.train(none, labels.limit(0))
    assert quality.judged(none, untrained).count() == 0


def test_score_depends_on_its_text_alone():
    net, rng = quality.ByteNet.fresh(quality.Training()), np.random.default_rng(5)
    for n in (0, 1, *range(118, 132), *range(248, 260), 1000, 1023, 1024):
        text = rng.integers(1, 256, n, dtype=np.uint8).tobytes()
        alone = net.scores([text])[0]
        for _ in range(10):
            others = [rng.integers(1, 256, rng.integers(1, 400), dtype=np.uint8).tobytes() for _ in range(2)]
            assert net.scores([others[0], text, others[1]])[1] == pytest.approx(alone, abs=1e-6)


def plain_score(net, text):
    """The network written out, window by window."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = text + bytes(quality.WIDTH)
    windows = [np.concatenate([p["embed"][b] for b in data[at : at + quality.WIDTH]]) @ p["filters"] for at in range(0, max(1, len(text)), quality.STRIDE)]
    blocks = [windows[at : at + quality.BLOCK] for at in range(0, len(windows), quality.BLOCK)]
    chunks = [blocks[i] + blocks[i + 1] for i in range(len(blocks) - 1)] or blocks
    acts = []
    for chunk in chunks:
        pooled = np.maximum(np.max(chunk, axis=0) + p["shift"], 0)
        acts.append(np.maximum(np.append(pooled, math.log(len(chunk) / (2 * quality.BLOCK))) @ p["hidden"] + p["bias"], 0))
    logit = np.concatenate([np.mean(acts, axis=0), np.max(acts, axis=0)]) @ p["out"] + p["prior"][0]
    return 1 / (1 + math.exp(-logit))


def test_scores_are_those_of_the_plain_network(monkeypatch):
    net, rng = quality.ByteNet.fresh(quality.Training()), np.random.default_rng(4)
    texts = [rng.integers(1, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 2, 127, 128, 129, 130, 255, 256, 257, 900, 1024, 3000, 1)]
    want = [plain_score(net, t) for t in texts]
    assert net.scores(texts) == pytest.approx(want, abs=1e-5)
    monkeypatch.setattr(quality, "PART", 2 * quality.STRIDE * quality.BLOCK)  # runs of two blocks
    assert net.scores(texts) == pytest.approx(want, abs=1e-5)


def test_memory_does_not_follow_the_text():
    import tracemalloc

    net = quality.ByteNet.fresh(quality.Training())
    text = b"some words of a very long text " * (50_000_000 // 31)
    tracemalloc.start()
    score = net.scores([b"short", text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500_000_000 and 0 <= score[1] <= 1


def test_gradients_agree_with_differences():
    t = quality.Training(filters=3, hidden=2, embed=2)
    net = quality.ByteNet.fresh(t)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, y, w = [b"some text " * 40, b"other!!"], np.array([1.0, 0.0]), np.ones(2)

    def loss():
        p = net.scores(texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net.gradients(texts, y, w)
    for name, at in (("filters", (3, 1)), ("hidden", (0, 1)), ("out", (1,)), ("embed", (ord("e"), 0)), ("prior", (0,))):
        before = loss()
        net.p[name][at] += 1e-5
        assert (loss() - before) / 1e-5 == pytest.approx(float(grads[name][at]), abs=2e-3)
        net.p[name][at] -= 1e-5


# 3 --------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_library(spark, docs, none, name):
    library, c = Tokenizer.from_file(public_tokenizers.path(name)), bpe.codec(tokenizer_json(name))
    rng = random.Random(7)
    alphabet = [*"abeEstTn'ldvrm .,!?\n\t 019éßΣ中'", "the", " and", "<|endoftext|>", "</w>", "aaaa", "\u3000", "İ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    for t in [*texts, *(t or "" for t in TEXTS)]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert c.encode(t) == ids, t
        assert c.decode(ids) == library.decode(ids, skip_special_tokens=False), t
        assert bpe.encoded(tokenizer_json(name), t).tolist() == ids, t
    both = docs.select("doc_id", "text").unionByName(sf_docs(spark).select("doc_id", "text"))
    want = []
    for i, t in pairs(both):
        ids = library.encode(t, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert rows_of(bpe.encoding_digests(both, name), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    digests = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in bpe.encoding_digests(docs, name).collect()}
    assert digests <= {x[:3] for x in want} and len(digests) == len(set(pairs(docs)))
    ids = bpe.encode_documents(docs, name)
    texts = bpe.decode_documents(ids, name)
    assert rows_of(texts, "doc_id", "text") == sorted(((i, library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in pairs(docs)), key=str)
    assert bpe.encoding_digests(none, name).count() == 0


# 4, 5, 7: SQL ------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    got = QUERIES[name](spark, "/root/testdata/sf0.01")
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, *want.columns) == sorted(want.fetchall(), key=str)


def test_url_cases(spark):
    cases = [
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://", "", "", None, "allow"),
        ("http://ORG/x", "org", "/x", "org/", "allow"), ("http://org", "org", "", None, "allow"), ("http://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"), ("x://example.org/en/19?q#f", "example.org", "/en/19", "example.org/en/1", "block"),
        ("http://a.com/FR/1", "a.com", "/FR/1", None, "allow"), ("http://a.com/fr/://b", "a.com", "/fr/://b", "com/fr/", "allow"), ("http://a.com?x=/de/", "a.com", "", None, "allow"),
        ("http://a.net/p?utm_source=feed", "a.net", "/p", None, "block"), ("http://a.net/p?utm_source=feeds", "a.net", "/p", None, "allow"), ("http://É.COM/de/\n", "É.com", "/de/\n", "com/de/", "block"),
    ]
    pages = spark.createDataFrame([(i, c[0], "h", "z") for i, c in enumerate(cases)] + [(None, "http://org/", "h", "z")], "page_id long, url string, html string, host string")
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judge_urls(pages).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)} | {None: ("org", "/", "org/", "allow")}
    assert urls.judge_urls(pages.limit(0)).count() == 0
    everything = (*urls.SITES, *urls.PATTERNS)
    index = urls.RuleIndex(list(everything), {})
    for url in (c[0] or "" for c in cases):  # the index loses no fitting rule
        assert {r for r in everything if r.fits(*urls.host_path(url), url)} <= set(index.candidates(url))
    again = spark.createDataFrame([(1, "http://org/", "h", "z")] * 3, "page_id long, url string, html string, host string")
    assert [tuple(r)[:5] for r in urls.judge_urls(again).collect()] == [(1, "org", "/", "org/", "allow")] * 3


def test_thousands_of_rules_from_a_table(spark):
    """Every rule against every URL, by plain text operations, and by the index."""
    rng = random.Random(13)
    words = ["ads", "shop", "cart", "img", "a", "b1", "news", "de", "x", "utm", "id", "page", "js", "org", "com", "example"]
    word = lambda: rng.choice(words) + (str(rng.randrange(40)) if rng.random() < 0.5 else "")
    rows = [("site", f"{word()}.{rng.choice(['com', 'org'])}/" + "/".join(word() for _ in range(rng.randrange(3))), rng.choice(["allow", "block"])) for _ in range(2500)]
    rows += [("pattern", "".join(rng.choice(["*", "^", "/", "?", "=", ".", "-", "_"]) + rng.choice([word(), word(), ""]) for _ in range(rng.randrange(1, 5))), rng.choice(["allow", "block"])) for _ in range(2500)]
    rows += [("pattern", "*", "block"), ("pattern", None, "block"), ("site", "", "allow"), ("site", "org/", None)]
    sites, patterns = urls.read_rules(spark.createDataFrame(rows, "kind string, text string, verdict string"))
    assert len(sites) + len(patterns) > 3500
    links = [f"http://{rng.choice(['', 'www.', 'A.'])}{word()}.{rng.choice(['com', 'org'])}" + "".join(rng.choice("/?=.-_&") + word() for _ in range(rng.randrange(6))) for _ in range(150)]
    links += ["http://x.com/" + "a-" * 50_000, "http://b1.org/" + "/ads-" * 20_000 + "end", None, "", "nothing"]

    def found(pattern, url):
        def ends(part, at):  # ends of the part's matches from a place on
            for start in range(at, len(url) + 1):
                place = start
                for c in part:
                    if c == "^" and place == len(url):
                        continue
                    if place >= len(url) or (url[place] != c if c != "^" else url[place].isascii() and url[place].isalnum()):
                        break
                    place += 1
                else:
                    return place
            return None

        at = 0
        for part in filter(None, pattern.split("*")):
            at = ends(part, at)
            if at is None:
                return False
        return True

    index = urls.RuleIndex([*sites, *patterns], {})
    for url in links:
        host, path = urls.host_path(url)
        site = max((r for r in sites if (host == r.site.partition("/")[0] or host.endswith("." + r.site.partition("/")[0])) and path.startswith("/" + r.site.partition("/")[2])), key=lambda r: (len(r.site), r.site), default=None)
        got = index.judge(url, "allow")
        assert got[:3] == (host, path, site.site if site else None)
        if site is None and len(url or "") < 1000:
            best = max((r for r in patterns if found(r.text, url or "")), key=lambda r: (len(r.text), r.text), default=None)
            assert got[3] == (best.verdict if best else "allow")
        assert got[4] < 0.6 * (len(sites) + len(patterns))
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(links)], "page_id long, url string")
    assert {r["page_id"]: tuple(r)[1:5] for r in urls.judge_urls(pages, sites, patterns).collect()} == {i: index.judge(u, "allow")[:4] for i, u in enumerate(links)}
    with pytest.raises(ValueError):
        urls.read_rules(spark.createDataFrame([("other", "x", "block")], "kind string, text string, verdict string"))


def test_topk_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0, 1) for i in range(300)]
    rows += [(300, None, 0, 1), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 1), (302, [float("nan")] * 6, 0, 1), (303, [float("inf")] * 6, 0, 1), (None, [1.0] * 6, 0, 1), (304, [1.0, 2.0], 0, 1), (305, [], 0, 1), (350, [1e9] * 6, 0, 1)]
    rows += [(400 + i, rows[50][1], 0, 1) for i in range(20)] + [rows[7]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank int")
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in whole if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in whole if i != q and len(x) == len(v))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = topk.top_k(table, F.col("vec_id") % 50 == 0)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=str)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# 6 --------------------------------------------------------------------------


def check_pieces(rows, texts, most_padding=None):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids_of = {t: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in {t for _, t in texts}}
    want = sorted(((i, len(ids_of[t])) for i, t in texts), key=str)
    by_sequence, seen, whole = {}, {}, []
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        if r["start"] == 0:
            whole.append((r["doc_id"], r["doc_tokens"]))
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert sorted(whole, key=str) == want
    totals = {}
    for i, n in want:
        totals[i] = totals.get(i, 0) + n
    assert seen == totals
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    crc = {}
    for i, t in texts:
        crc.setdefault(i, []).append(ids_of[t])
    for r in rows:
        assert r["ids_crc32"] in {zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for x in crc[r["doc_id"]]}
    if most_padding is not None:
        assert padding <= most_padding * sum(totals.values())


def test_packing(spark, docs, none):
    check_pieces(packing.pack(docs).collect(), pairs(docs))
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_pieces(packing.pack(sf).collect(), pairs(sf), 0.01)
    assert packing.pack(none).count() == 0


def test_plan_is_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(20):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 900, 40))])
        extra = np.concatenate([[0], rng.choice([0, packing.SENTENCE, packing.INSIDE], 40)]).astype(float)
        extra[-1] = 0

        def price(i, j):
            n = at[j] - at[i]
            power = n & (n - 1) == 0 and packing.LEAST_POWER <= n < packing.WINDOW
            return (0 if power else packing.WINDOW - n) + packing.EACH + extra[j]

        best = [0.0] + [math.inf] * 40
        for j in range(1, 41):
            best[j] = min(best[i] + price(i, j) for i in range(j) if at[j] - at[i] <= packing.WINDOW)
        cuts = packing.plan(at, extra, False)
        place = {int(a): i for i, a in enumerate(at)}
        steps = [0, *(place[c] for c in cuts)]
        assert sum(price(a, b) for a, b in zip(steps, steps[1:], strict=False)) == pytest.approx(best[steps[-1]])
        low = np.searchsorted(at, at[-1] - packing.WINDOW)
        assert best[steps[-1]] == pytest.approx(min(best[max(1, low) :]))


def test_blocks_continue_the_stream(docs, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 1)  # plan after every document
    stream, pieces = packing.Stream(tokenizer_json("word_bpe_49k.json"), 0), []
    texts = [(i, t or "") for i, t in enumerate(TEXTS)]
    for i, t in texts:
        stream.add(i, bpe.encoded(tokenizer_json("word_bpe_49k.json"), t))
        pieces += stream.flush(False)
    pieces += stream.flush(True)
    check_pieces([dict(zip([n for n, _ in packing._PIECES], p, strict=True)) for p in pieces], texts)


def test_short_documents_take_little_memory():
    stream = packing.Stream(tokenizer_json("word_bpe_49k.json"), 0)
    tracemalloc.start()
    try:
        for i in range(100_000):
            stream.add(i, np.zeros(0, "<u4"))
        pieces = sum(p[1:3] == (0, 1) for p in stream.flush(True))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pieces == 100_000 and peak < 200 * pieces


# 7 --------------------------------------------------------------------------


def test_exact_groups(spark, docs, none):
    groups = {}
    texts = pairs(docs)
    for i, t in texts:
        groups.setdefault(ascii_lower(t), []).append(i)
    largest = lambda g: max((i for i in g if i is not None), default=None)
    want = sorted(((i, largest(groups[ascii_lower(t)]), len(groups[ascii_lower(t)]), hashlib.sha256(ascii_lower(t)).hexdigest()) for i, t in texts), key=str)
    got = exact.exact_groups(docs)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = got.where("kept").collect()
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    winners = exact.keep_winners(docs)
    assert winners.columns == docs.columns and len({ascii_lower(t) for _, t in pairs(winners)}) == winners.count() == len(groups)
    assert exact.exact_groups(none).count() == 0 and exact.keep_winners(none).count() == 0


def test_perfect_hash_is_minimal_and_checked(spark, docs):
    digests = exact._digest_rows([hashlib.sha256(str(i).encode()).digest() for i in range(5000)])
    mph = exact.PerfectHash.build(digests)
    assert sorted(mph.slots(digests).tolist()) == list(range(5000))
    again = exact.PerfectHash.unpacked(mph.packed(), mph.rest.tobytes())
    assert (again.slots(digests) == mph.slots(digests)).all()
    history = exact.digest_groups(exact.text_digests(docs.where("doc_id % 2 = 0")))
    found = exact.delivered(stored(exact.text_digests(docs), "delivery"), stored(exact.build_index(history, 3), "index"), 3).collect()
    old = {hashlib.sha256(ascii_lower(t)).digest() for _, t in pairs(docs.where("doc_id % 2 = 0"))}
    assert len(found) == docs.count() and all(r["member"] == (bytes(r["digest"]) in old) for r in found)
    fresh = [r for r in found if not r["member"]]
    assert fresh and all(r["size"] == sum(x["digest"] == r["digest"] for x in fresh) for r in fresh)
    counts = {bytes(r["digest"]): r["size"] for r in history.collect()}
    assert all(r["size"] == counts[bytes(r["digest"])] + sum(x["digest"] == r["digest"] for x in found) for r in found if r["member"])


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_groups_do_not_depend_on_the_history(docs, monkeypatch, share):
    want = rows_of(exact.exact_groups(docs), "doc_id", "keep_id", "group_size", "text_sha256")
    monkeypatch.setattr(exact, "HISTORY", share)
    assert rows_of(exact.exact_groups(docs), "doc_id", "keep_id", "group_size", "text_sha256") == want


@pytest.mark.parametrize("keep", [exact.keep_winners, neardup.keep_representatives])
def test_kept_rows_do_not_depend_on_splits(spark, monkeypatch, keep):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(300)]
    rows = [(i, texts[i % 300]) for i in range(600)]
    table = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), "copies")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)

    def then_other_splits(df, label):
        out = stored(df, label)
        spark.conf.set(size, "3k")
        return out

    for module in (exact, neardup, shared):
        monkeypatch.setattr(module, "stored", then_other_splits)
    try:
        kept = sorted(r["doc_id"] for r in keep(table).collect())
    finally:
        spark.conf.set(size, before)
    assert kept == (list(range(300, 600)) if keep is exact.keep_winners else list(range(300)))


# 8 --------------------------------------------------------------------------


def test_id_files(spark, docs, none, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids_of = {t: [*library.encode(t, add_special_tokens=False).ids, 2] for _, t in pairs(docs)}
    files = idfiles.write_ids(docs, str(tmp_path / "ids"), file_tokens=700)
    got = idfiles.read_ids(files).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == sorted(((i, ids_of[t]) for i, t in pairs(docs)), key=str)
    stream = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in stream] == np.cumsum([0, *(len(r["ids"]) for r in stream)])[:-1].tolist()
    order = [r["doc_id"] for r in stream]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    want = sorted(((r["doc_id"], r["start"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got), key=str)
    assert rows_of(idfiles.id_digests(files), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert idfiles.round_trip(none).count() == 0


def test_codes_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 1001):
        v = rng.integers(0, 2 ** rng.integers(1, 33, n), dtype=np.uint64).astype(np.uint32) if n else np.zeros(0, np.uint32)
        control, data = idfiles.encode_codes(v)
        assert len(control) == -(-n // 4)
        assert (idfiles.decode_codes(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == v).all()


# 9 --------------------------------------------------------------------------


def plain_blocks(words):
    """Every start of every template's block, by sets."""
    out = []
    for label, t in licenses.TEMPLATES:
        own = set(t.split())
        needed = math.ceil(licenses.THRESHOLD * len(own) - 1e-9)
        for start in range(max(0, len(words) - licenses.BLOCK) + 1):
            shared = len(own & set(words[start : start + licenses.BLOCK]))
            if shared >= needed:
                out.append((label, t, start, shared / len(own)))
    return out


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_licenses(text):
    words = plain_words(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    blocks = plain_blocks(words)
    at = [i for i, _ in places]
    base = {x for _, x in places}
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in blocks})), 1.0 if at else max((x[3] for x in blocks), default=0.0)


def test_licenses(spark, docs, none):
    filler = "word " * 50
    notices = [filler + t + " " + filler * (k % 4) for k, (_, t) in enumerate(licenses.TEMPLATES)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate([*notices, " ".join(notices)])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more).unionByName(sf_docs(spark).where("n_chars < 5000").select("doc_id", "text"))
    want = sorted(((i, *plain_licenses(t)) for i, t in pairs(both)), key=str)
    assert rows_of(licenses.license_labels(both), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == want
    assert {"cc-by-nc", "bsd", "isc"} <= {x for r in want for x in r[6].split(",")}
    assert licenses.license_labels(none).count() == 0
    assert licenses.license_labels(docs).count() == docs.count()  # columns with clashing names


def test_every_block_start_is_found():
    """A sentence stretched over 58 words is met at any offset; runs are those of all starts."""
    index = licenses.TemplateIndex(licenses.ordered_templates(licenses.TEMPLATES, {}, licenses.THRESHOLD))
    rng = random.Random(11)
    sentence = licenses.TEMPLATES[0][1].split()
    for offset in range(96):
        slots = sorted(rng.sample(range(1, 57), len(sentence) - 2))
        block = ["filler"] * 58
        for at, word in zip([0, *slots, 57], sentence, strict=True):
            block[at] = word
        words = ["lead"] * offset + block + ["tail"] * rng.randrange(120)
        found = index.matches([w.encode() for w in words])
        assert ("mit", 1.0) in {(m[0], m[3]) for m in found}
        starts = sorted((label, s) for label, a, b, _ in found for s in range(a, b + 1))
        assert starts == sorted((label, s) for label, _, s, _ in plain_blocks(words))


# 10 -------------------------------------------------------------------------


def plain_groups(texts, words, radius):
    prints = []
    for _, t in texts:
        parts = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if w]
        runs = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    best = {}
    for (i, _), g in zip(texts, group, strict=True):
        if i is not None:
            best[g] = min(best.get(g, i), i)
    return sorted(((i, f"{p:016x}", best.get(g)) for (i, _), p, g in zip(texts, prints, group, strict=True)), key=str)


def test_near_groups(spark, docs, none):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    edits = []
    for k in range(40):
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(300)] = "edit"
        edits.append((200 + k, " ".join(copy)))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(edits, "doc_id long, text string")).unionByName(sf_docs(spark).where("n_chars < 2000").select("doc_id", "text"))
    want = plain_groups(pairs(both), 4, 4)
    got = neardup.near_groups(stored(both, "both")).withColumn("fingerprint", F.lower(F.hex("fp")))
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == want
    odd = neardup.near_groups(docs)  # columns with clashing names
    assert rows_of(odd.withColumn("fingerprint", F.lower(F.hex("fp"))), "doc_id", "fingerprint", "component_id") == plain_groups(pairs(docs), 4, 4)
    kept = neardup.keep_representatives(stored(both, "both"))
    texts = [t for _, t in pairs(kept)]
    assert len({ascii_lower(t) for t in texts}) == len(texts)
    assert sum(i is not None and i >= 200 for i, _ in pairs(kept)) == 1
    assert neardup.near_groups(none).count() == 0 and neardup.keep_representatives(none).count() == 0


@pytest.mark.parametrize("crowd", [neardup.SHARD, 3])
def test_minima_lose_no_similar_pair(spark, monkeypatch, crowd):
    monkeypatch.setattr(neardup, "SHARD", crowd)
    rng, texts = random.Random(4), []
    for _ in range(30):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(8, 150))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    table = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "copies")
    rows = stored(neardup.set_rows(table.withColumn("row", F.col("doc_id")), "row", 5, 0.8, 10), "sets")
    classes = stored(neardup.set_classes(rows), "classes")
    comps: dict = {}
    for r in neardup.candidate_groups(classes, 0.8).collect():
        comps.setdefault(bytes(r["fp"]), set()).add(bytes(r["comp"]))
    fp = {r["doc_id"]: bytes(r["fp"]) for r in rows.collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if fp[i] != fp[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                assert comps[fp[i]] & comps[fp[j]]


def test_boilerplate_joins_no_groups(spark):
    """Pairs of near copies that all share one long passage stay groups of two: work is linear in rows."""
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    passage, texts = fresh(45), []
    for _ in range(150):
        own = fresh(100)
        texts += [" ".join([*passage, *own]), " ".join([*passage, *own[:-3], *fresh(3)])]
    table = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "boilerplate")
    rows = stored(neardup.set_rows(table.withColumn("row", F.col("doc_id")), "row", 5, 0.8, 10), "sets")
    sizes = [r["count"] for r in neardup.candidate_groups(stored(neardup.set_classes(rows), "classes"), 0.8).groupBy("comp").count().collect()]
    assert sum(sizes) <= 10 * len(texts)
    kept = neardup.keep_representatives(table)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 300, 2))


def plain_shingles(text, words):
    parts = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def plain_similar(texts, words, similarity):
    """Group number of each text: exact Jaccard of every pair; texts without words are one group."""
    sets = [plain_shingles(t, words) for t in texts]
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or (shared and shared >= similarity * (len(sets[i]) + len(sets[j]) - shared) - 1e-9):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    return [find(i) for i in range(len(texts))]


def plain_representatives(rows, words=5, similarity=0.8):
    """Smallest doc_id of each group; the rows have distinct ids."""
    best = {}
    for (i, _), g in zip(rows, plain_similar([t for _, t in rows], words, similarity), strict=True):
        best[g] = min(best.get(g, i), i)
    return sorted(best.values())


def similar_texts():
    """Copies around similarity 0.8 on both sides, of every length."""
    rng, texts = random.Random(8), []
    fresh = lambda: f"w{rng.randint(0, 10**6)}"
    for n in [*range(1, 16), *range(20, 110, 9), 180, 300, 454]:
        base = [fresh() for _ in range(n)]
        texts.append(base)
        for share in (0.6, 0.7, 0.78, 0.8, 0.82, 0.9):
            size = max(1, n - 4)
            cut = round(size * (1 - share))  # words cut at the end: similarity (size - cut) / size
            texts += [base[: n - cut], [*base[: n - cut // 2], *(fresh() for _ in range(cut - cut // 2))]]
            k = round(size * (1 - share) / (1 + share) / 5 + 0.3)  # each edit changes five shingles on both sides
            copy = list(base)
            for at in rng.sample(range(n), min(n, k)):
                copy[at] = fresh()
            texts.append(copy)
    line = [fresh() for _ in range(30)]
    texts += [[*line, *(fresh() for _ in range(rng.randint(0, 60)))] for _ in range(60)]  # one line in common
    return [" ".join(t) for t in texts] + ["", " "]


@pytest.mark.parametrize("work", [neardup.WORK, 2000])
def test_representatives_are_those_of_exact_similarity(spark, monkeypatch, work):
    monkeypatch.setattr(neardup, "WORK", work)
    texts = similar_texts()
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    table = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "similar")
    assert sorted(r["doc_id"] for r in neardup.keep_representatives(table).collect()) == plain_representatives(rows)


def test_candidates_lie_within_the_finder():
    rng, radius = np.random.default_rng(6), neardup.finder_radius(0.8, 128)
    worst = 0
    for n in (neardup.FEW + 1, 90, 180, 450):
        for _ in range(300):
            hashes = rng.integers(0, 256, (n + n // 9, 16), dtype=np.uint8)
            a, b = (np.frombuffer(neardup.majority(x), "<u8") for x in (hashes[:n], hashes[n // 9 :]))
            worst = max(worst, int(np.bitwise_count(a ^ b).sum()))
    assert 25 < worst <= radius < 50


def test_shards_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**64, 60, dtype=np.uint64)
    values = np.unique(np.concatenate([centres, *(centres ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 64, (12, 2)))]))
    monkeypatch.setattr(neardup, "SHARD", 50)
    table = spark.createDataFrame([(int(v).to_bytes(8, "big"),) for v in values], "fp binary")
    edges = [(bytes(r["a"]), bytes(r["b"])) for r in neardup.near_edges(table, 4).collect()]
    group = {int(v).to_bytes(8, "big"): k for k, v in enumerate(values)}
    want = dict(group)
    near = np.argwhere(np.bitwise_count(values[:, None] ^ values[None]) <= 4)

    def joined(labels, links):
        while any(labels[a] != labels[b] for a, b in links):
            for a, b in links:
                labels[a] = labels[b] = min(labels[a], labels[b])
        return labels

    keys = list(group)
    assert joined(group, edges) == joined(want, [(keys[a], keys[b]) for a, b in near])


# pipeline -------------------------------------------------------------------


def test_pipeline(spark):
    docs, sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "/root/testdata/sf0.01"
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, sf), "stage")
        assert kept.columns == columns and 0 < kept.count() < docs.count(), name
        assert kept.exceptAll(docs).count() == 0
        docs = kept
    assert docs.select(F.sha2(F.lower("text"), 256)).distinct().count() == docs.count()
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), pairs(docs), 0.02)


def test_pipeline_stages_take_odd_rows(spark, docs, none):
    plain = ("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, docs.select(*plain), none):
        for _, stage in corpus_pipeline.STAGES:
            table = stored(stage(spark, table, SF), "stage")
        assert table.columns[:2] == ["doc_id", "start"]


def test_pipeline_equals_plain_computation(spark):
    sf = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(similar_texts())] + [(2 * 10**6, "Same TEXT twice"), (2 * 10**6 + 1, "same text TWICE")], "doc_id long, text string")
    docs = stored(sf.unionByName(more), "plain")
    stages = dict(corpus_pipeline.STAGES)

    net = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {i: net.scores([t.encode()])[0] for i, t in pairs(docs)}
    kept = {i for i, _ in pairs(stages["quality"](spark, docs, SF))}
    close = {i for i, s in scores.items() if abs(s - quality.THRESHOLD) < 1e-5}
    assert kept - close == {i for i, s in scores.items() if s >= quality.THRESHOLD} - close

    winners = {}
    for i, t in pairs(docs):
        winners[ascii_lower(t)] = max(winners.get(ascii_lower(t), i), i)
    exact_kept = stored(stages["exact dedup"](spark, docs, SF), "exact")
    assert sorted(i for i, _ in pairs(exact_kept)) == sorted(winners.values())

    near_kept = stored(stages["near dedup"](spark, exact_kept, SF), "near")
    assert sorted(i for i, _ in pairs(near_kept)) == plain_representatives(pairs(exact_kept))

    check_pieces(stages["packing"](spark, near_kept, SF).collect(), pairs(near_kept))


def test_workers_give_arrow_memory_back(spark):
    import pyarrow as pa

    assert pa.default_memory_pool().backend_name == "system"
