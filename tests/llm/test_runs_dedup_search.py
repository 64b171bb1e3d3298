"""Periodic runs, exact duplicates and ranked search against brute force: nulls,
empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tablewright.llm import exact_dedup, ranked_search, runs

DOCS = "doc_id long, text string, lang string"


# ---- periodic runs -----------------------------------------------------------

def brute_runs(ws, min_words=24, min_repeats=3):
    w, out = np.unique(np.array(ws, object).astype(str), return_inverse=True)[1] if ws else np.zeros(0), {}
    for q in range(1, len(ws) // min_repeats + 1):
        d = np.diff(np.concatenate(([0], (w[:-q] == w[q:]).astype(int), [0])))
        for s, e in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()):
            if e - s + q >= max(min_words, min_repeats * q):
                out.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def random_words(rng):
    kind, few = rng.randrange(6), rng.choice([1, 2, 3, 20])
    if kind == 0:
        return [rng.randrange(few) for _ in range(rng.randrange(200))]
    if kind == 1:
        base = [rng.randrange(few) for _ in range(rng.randrange(1, 30))]
        return [rng.randrange(5) for _ in range(9)] + base * rng.randrange(1, 12) + base[: rng.randrange(len(base))] + [rng.randrange(5) for _ in range(9)]
    if kind == 2:
        a, b = [0], [0, 1]
        for _ in range(rng.randrange(3, 11)):
            a, b = b, b + a
        return b
    if kind == 3:
        return [x for _ in range(5) for x in [rng.randrange(3) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 20)]
    if kind == 4:
        return [rng.randrange(2) for _ in range(60)] * 3 + [7] * rng.randrange(40)
    return (([0] * rng.randrange(1, 40) + [1]) * rng.randrange(1, 5)) * rng.randrange(1, 5)


def runs_in(docs):
    ids = np.array([x for d in docs for x in d], np.int64)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    at = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    out = [[] for _ in docs]
    for s, e, q in runs.runs_of(ids, row, 24, 3).T.tolist():
        out[row[s]].append((s - int(at[row[s]]), e - s, q))
    return out


def test_runs_of_random_sequences():
    rng, seen = random.Random(3), 0
    for _ in range(120):
        docs = [random_words(rng) for _ in range(rng.randrange(1, 5))]
        want = [brute_runs(d) for d in docs]
        assert runs_in(docs) == want
        seen += sum(map(len, want))
    assert seen > 300


def test_runs_survive_hash_collisions(monkeypatch):
    """Stretches that only look equal by hash are found out word by word."""
    true = runs.Words.same
    monkeypatch.setattr(runs.Words, "same", lambda self, i, q, n: true(self, i, q, n) | ((i * 31 + q * 7 + n) % 5 == 0))
    rng = random.Random(8)
    for _ in range(60):
        docs = [random_words(rng) for _ in range(2)]
        got = runs_in(docs)
        for d, g in zip(docs, got):
            assert set(g) <= set(brute_runs(d))
    morse = [0]
    while len(morse) < 4096:
        morse += [1 - x for x in morse]
    monkeypatch.undo()
    assert runs_in([morse]) == [[]] == [brute_runs(morse)]


def tail(doc_id, ws):
    if doc_id is None or not ws:
        return ws
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(ws)
    if h % 10:
        return ws
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def want_runs(doc_id, text):
    ws = tail(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found, gone = brute_runs(ws), set()
    for s, n, q in found:
        gone |= set(range(s + q, s + n))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_periodic_runs_of_documents(frame):
    rng = random.Random(5)
    rows = [(i, " ".join("w%d" % x if i % 3 else "é%d\t" % x for x in random_words(rng)), "en") for i in range(250)]
    rows += [(300, None, None), (301, "", "en"), (302, " \n\t ", "en"), (303, "one two", "en"), (None, "a b " * 30, "en"), rows[7], rows[7],
             (304, "A a " * 40, "en"), (305, "x" * 50000 + " tail", "en"), (306, "go on and on \n" * 15000, "en"), (307, "a b " * 25, "en")]
    got = runs.digest(runs.periodic_runs(runs.with_periodic_tails(frame(rows, DOCS)))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((want_runs(d, t) for d, t, _ in rows), key=str)
    assert sum(1 for d, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 10 == 0) > 10
    assert runs.periodic_runs(frame([], DOCS)).collect() == []
    spans = {r["doc_id"]: r for r in runs.periodic_runs(frame(rows[:3] + [(9, "p q " * 20 + "end", "en")], DOCS)).collect()}
    assert [tuple(x) for x in spans[9]["runs"]] == [(0, 40, 2)] and spans[9]["collapsed"] == "p q end" and spans[9]["n_words"] == 41


# ---- exact duplicates --------------------------------------------------------

def passage(n, seed):
    rng = random.Random(seed)
    return " ".join("w%d" % rng.randrange(5000) for _ in range(n))


@pytest.fixture(scope="module")
def copies():
    rows, long = [], [passage(9000, s) for s in range(3)]
    for i in range(60):
        text = [passage(3 + i % 5, i % 7), long[i % 3], long[i % 3] + " x", "y " + long[i % 3], passage(900, i), "Same text" if i % 2 else "Same  text"][i % 6]
        rows.append((i * 7 % 61, text, "en"))
    return rows + [(200, None, None), (201, "", "en"), (202, " ", "en"), (203, "é", "en"), (204, "é", "en"), rows[3], rows[3],
                   (None, rows[5][1], "en"), (None, "alone", "en"), (None, "two", "en"), (None, "two", "de"), (205, "z" * 200000, "en"), (206, "z" * 200000, "en"), (207, "z" * 199999, "en")]


def want_groups(rows):
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(t or "", []).append(d)
    key = lambda d: -math.inf if d is None else d
    return sorted(((d, max(groups[t or ""], key=key), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in rows), key=str)


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_groups(frame, copies, digest_bytes):
    """With digests of one byte different chunks meet and all are drawn anew."""
    got = exact_dedup.exact_groups(frame(copies, DOCS), digest_bytes=digest_bytes).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want_groups(copies)
    kept = [(r["doc_id"], r["keep_id"], r["text_sha256"]) for r in got if r["kept"]]
    assert all(a == b for a, b, _ in kept) and len(kept) == len({t or "" for _, t, _ in copies}) == len({s for *_, s in kept})


def test_exact_groups_of_nothing(frame):
    assert exact_dedup.exact_groups(frame([], DOCS)).collect() == []
    got = exact_dedup.exact_groups(frame([(1, "a", "en"), (2, "b", "en")], DOCS)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(1, 1, 1, True), (2, 2, 1, True)]


def test_chunks_follow_the_content():
    """Equal passages at other places give equal chunks but for the first and last."""
    cutter, body = exact_dedup.Chunker(0, 16), passage(40000, 1).encode()

    def chunks(raw):
        ends = cutter.cuts(np.frombuffer(raw, np.uint8))
        assert ends[-1] == len(raw) and all(b - a <= exact_dedup.MAX_CHUNK for a, b in zip([0, *ends], ends))
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    one, two = chunks(body), chunks(b"some words before " * 300 + body)
    assert b"".join(one) == body and len(set(one) - set(two)) <= 3 and len(one) > 30
    assert chunks(b"")[0] == b"" and len(chunks(b"z" * 100000)) == -(-100000 // exact_dedup.MAX_CHUNK)


# ---- ranked search -----------------------------------------------------------

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_search(docs, items, k):
    cut = [(d, Counter(terms(t))) for d, t, _ in docs]
    n_docs, n_terms = sum(1 for _, c in cut if c), sum(c.total() for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for d, c in cut:
            m = 10 + 90 * c.total() * n_docs // n_terms if n_terms else 1
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(4)
    vocab = ["Alpha", "beta", "gamma-ray", "d'or", "été", "naïve", "x_1", "42", "3.14", "日本語", "𝔘nit", "Ωmega", "İstanbul", *("t%d" % i for i in range(60))]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 90))), "en") for i in range(300)]
    docs += [(d, docs[5][1], "en") for d in (900, 5, 5)] + [(400, None, None), (401, "", "en"), (402, "-- !!", "en"), (None, docs[6][1], "en"), (403, "beta " * 60000, "en")]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    items += [(50, None), (51, ""), (52, "?!"), (53, "unheard of"), (None, "alpha 42"), (3, "été"), (54, docs[5][1]), items[0]]
    return docs, items


@pytest.mark.parametrize("k, block", [(10, 2_000_000), (3, 60)])
def test_ranked_search(frame, library, k, block):
    docs, items = library
    got = ranked_search.ranked_search(frame(docs, DOCS), frame(items, "item_id long, text string"), k, block_postings=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, k)


def test_ranked_search_of_nothing(frame, library):
    docs, items = library
    search = lambda d, i: ranked_search.ranked_search(frame(d, DOCS), frame(i, "item_id long, text string")).collect()
    assert search([], items) == [] == search(docs, []) == search([(1, None, None)], items) == search(docs, [(1, None)])
