"""Operators over document texts against brute force on small tables: nulls,
empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import bpe, decontam, jaccard, quality, secret_scan, sharding, textvec, token_counts
from tablewright.llm.components import connected_components
from tablewright.llm.queries import PIECE_MODEL, rank_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups".split()) + str(rng.randrange(40)) for _ in range(n)]


def near(ws, k, seed):
    rng, ws = random.Random(seed), list(ws)
    for _ in range(k):
        ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
    return ws


@pytest.fixture(scope="module")
def corpus():
    rows, i = [], 0
    for g in range(25):
        base = words(20 + 17 * g, g)
        for k in (0, 0, 1, 2, 3, 6, 12):
            rows.append((i, " ".join(near(base, k, 100 * g + k)), "en", f"s{i % 4}", 0))
            i += 1
    passage = " ".join(words(60, 999))
    for j in range(30):
        rows.append((i, passage + " " + " ".join(words(30 + j, 2000 + j)), "de", f"s{i % 4}", 0))
        i += 1
    rows += [(i, None, None, None, None), (i + 1, "", "en", "s1", 0), (i + 2, " \t\n", "en", "s1", 0), (i + 3, "One two", "en", "s1", 0), (i + 4, "one  TWO", "en", "s1", 0),
             (None, rows[0][1], "en", "s1", 0), (i + 5, "word " * 30000, "en", "s2", 0), rows[3], (i + 6, "é\u00a0è ß x y z", "fr", "s0", 0)]
    return rows


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, parent, inv = {}, {}, defaultdict(list)
    for d, t, *_ in rows:
        if d is not None:
            sets[d], parent[d] = shingles(t), d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        c = Counter()
        for s in sets[d]:
            c.update(inv[s])
            inv[s].append(d)
        for o, n in c.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[o]) - n):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_jaccard_components(frame, corpus):
    got = jaccard.jaccard_components(frame(corpus, DOCS)).collect()
    want = brute_components(corpus)
    assert len(got) == len(corpus)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (want[r["doc_id"]] if r["doc_id"] is not None else (len(shingles(corpus[0][1])), None))
    assert len({c for _, c in want.values()}) < len(want)


def test_jaccard_blocks(frame, corpus, monkeypatch):
    """Groups larger than a block, and no common shingles known: the same links."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "SAMPLE_TEXTS", 1)
    got = jaccard.jaccard_components(frame(corpus, DOCS)).where("doc_id IS NOT NULL").collect()
    want = brute_components(corpus)
    assert all(want[r["doc_id"]][1] == r["component_id"] for r in got)


def test_jaccard_empty(frame):
    assert jaccard.jaccard_components(frame([], DOCS)).collect() == []


def test_jaccard_repeated_id(frame):
    """An id with a long and a short text links by either."""
    long = words(200, 1)
    rows = [(5, " ".join(long), "en", "s", 0), (5, " ".join(words(12, 2)), "en", "s", 0), (7, " ".join(near(long, 2, 3)), "en", "s", 0)]
    got = jaccard.jaccard_components(frame(rows, DOCS)).collect()
    assert len(got) == 3 and {r["component_id"] for r in got} == {5}


def test_signatures_meet():
    """Any two linked sets share a signature, whatever the common shingles."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 9, 15, 16, 17, 31, 33, 60, 120, 127, 128, 129, 300, 700):
        for _ in range(12):
            base = np.unique(rng.integers(0, 2 ** 63, 2 * n).astype(np.uint64) * np.uint64(2))
            # the largest difference that still links, by removals on one side or both
            a = base[:n]
            drop = rng.integers(0, n // 4 + 1)
            b = np.sort(np.concatenate([a[drop:], base[n: n + rng.integers(0, max(1, n // 3))]]))
            if not jaccard.linked(a, b):
                continue
            common = np.sort(rng.choice(base, len(base) // 2, replace=False)) if n > 4 else base[:0]
            assert set(jaccard.signatures(a, common).tolist()) & set(jaccard.signatures(b, common).tolist()), (n, drop)
            assert jaccard.can_link(len(a), len(b), jaccard.sketch(a), jaccard.sketch(b))


def test_word_hashes_across_blocks():
    """Words keep their hash whatever block they fall into."""
    h = textvec.WordHasher()
    text = " ".join(words(300, 5)) + " " + "x" * 5000 + " end"
    whole = list(h.sets(pa.array([text])))[0]
    h2 = textvec.WordHasher()
    h2.BLOCK = 64
    assert (list(h2.sets(pa.array(["a", text])))[1] == whole).all()
    assert len(whole) == len(shingles(text))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, None), (7, 7)]
    parent = {v: v for e in edges for v in e if v is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if v is not None:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r["v"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for v in parent if find(v) != v}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


# ---- sharding ---------------------------------------------------------------

def test_shards_are_exact(frame, corpus):
    df = frame(corpus, DOCS).repartition(5)
    got = sharding.shuffle_into_shards(df, 8).select("doc_id", "text", "x", "shard", "slot").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in corpus)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert {r["x"] for r in got} == {"extra"}


def test_shards_of_few_rows(frame):
    assert sharding.shuffle_into_shards(frame([], DOCS)).collect() == []
    got = sharding.shuffle_into_shards(frame([(1, None, None, None, None)] * 3, DOCS), 8).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (1, 0), (2, 0)]


def test_communication_matrix():
    rng = np.random.default_rng(0)
    rows, cols = [5, 0, 17, 3, 30], [11, 11, 11, 11, 11]
    total = np.zeros((5, 5))
    for seed in range(400):
        m = sharding.communication_matrix(rows, cols, seed)
        assert m.sum(1).tolist() == rows and m.sum(0).tolist() == cols and (m >= 0).all()
        total += m
    assert np.abs(total / 400 - np.outer(rows, cols) / 55).max() < 0.35
    draws = [sharding.hypergeometric(30, 50, 20, rng) for _ in range(4000)]
    other = np.random.default_rng(1).hypergeometric(30, 50, 20, 4000)
    assert abs(np.mean(draws) - other.mean()) < 0.15 and abs(np.std(draws) - other.std()) < 0.15
    big = sharding.hypergeometric(10 ** 12, 10 ** 12, 10 ** 9, rng)
    assert abs(big - 5 * 10 ** 8) < 10 ** 6


def test_digest(frame):
    import zlib
    got = sharding.digest(frame([(1, "aé", None, None, None), (2, None, None, None, None)], DOCS)).collect()
    assert [tuple(r) for r in got] == [(1, 4, zlib.crc32("aé".encode())), (2, 1, 0)]


def test_shards_exchange_texts(spark, monkeypatch):
    """The query shuffles documents with their texts; its digests come from the shuffled rows."""
    from tablewright.llm import queries
    seen, real = [], sharding.shuffle_into_shards
    monkeypatch.setattr(sharding, "shuffle_into_shards", lambda df, *a: seen.append(df.columns) or real(df, *a))
    out = queries.op1_hypergeometric_shards(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert seen == [docs.columns]
    assert sorted(map(tuple, out.select("doc_id", "size", "text_crc32").collect())) == sorted(map(tuple, sharding.digest(docs).collect()))


# ---- secrets ----------------------------------------------------------------

KEY = "AKIA" + "QWERTY1234567890"


def secret_rows():
    live = "token = 'abcdef123456' and x"
    rows = [(1, live, "en", "s1", len(live)), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, "Secret: token: abcdefgh PASSWD=:=x=12345", "en", "s1", 40)]
    rows += [(10 + i, f"é key {KEY} copied {i}", ("en", "fr", "de")[i], f"s{i}", 0) for i in range(3)]
    rows += [(20, "deadbeef" * 4 + " AKIA" + "A" * 15 + " api_key=\"0123456789abcdef0123456789\"", "en", "s9", 0)] * 2
    rows += [(30, " ".join(f"apikey={i:06d}" for i in range(3000)), "en", "s3", 0)]
    rows += [(40, "ghp_" + "a1B2" * 10 + " -----BEGIN RSA PRIVATE KEY-----", "en", "s4", 0)]
    # copies of one text are one document; a token begins where its run of characters does
    rows += [(50 + i, "one text ghp_" + "z9Y8" * 10, ("en", "fr", "de")[i], f"s{i}", 0) for i in range(3)]
    web = "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    rows += [(60, f"{web} é({web}),{web}. x{web} a.{web} eyJshort.eyJshort.x eyJ{'a' * 40}.{'b' * 9}", "en", "s6", 0), (61, web, "en", "s6", 0)]
    return rows


def brute_spans(text):
    out = []
    for i, (kind, p, g, n) in enumerate(secret_scan.BASE + secret_scan.ADDED):
        for m in re.finditer(p, text or "", re.ASCII):
            if len(m.group(g)) >= n:
                out.append((m.start(g if kind == "jwt" else 0), i, kind, m.end(), m.group(g)))
    return sorted(out)


def test_secret_scan(frame):
    rows = secret_rows()
    owners, of_text = defaultdict(set), defaultdict(set)
    for _, t, lang, source, _ in rows:
        of_text[t or ""].add((source or "", lang or ""))
    for t, o in of_text.items():
        for *_, v in brute_spans(t):
            owners[v].add(min(o))
    got = secret_scan.report(secret_scan.scan(frame(rows, DOCS))).collect()
    text = {r[0]: r[1] for r in rows}
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    for r in got:
        spans = brute_spans(text[r["doc_id"]])
        base = [s for s in spans if s[1] < 3]
        live = [s for s in spans if len(owners[s[4]]) < 3]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[2] == k for s in base) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b, _ in base).encode()).hexdigest()
        assert r["spans"] == ",".join(f"{s[2]}:{s[0]}:{s[3]}" for s in spans if s[1] < 3 or s in live)
        assert r["n_live"] == len(live)
    assert {r["doc_id"]: r["n_example"] for r in got}[10] == 1
    assert {r["doc_id"]: r["n_live"] for r in got}[50] == 1 and sum(k.startswith("jwt") for r in got if r["doc_id"] == 60 for k in r["spans"].split(",")) == 3


def test_secret_scan_time_follows_the_length(frame):
    """A million characters that begin a token everywhere, and other long runs."""
    import time
    rows = [(1, "eyJ" * 340000, "en", "s1", 0), (2, "eyJabcdefgh." * 80000, "en", "s1", 0), (3, "-----BEGIN " * 90000, "en", "s1", 0), (4, "token" * 200000, "en", "s1", 0), (5, "0123abcd " * 110000, "en", "s1", 0)]
    secret_scan.report(secret_scan.scan(frame([(0, "token = 'abcdef123456'", "en", "s", 0)], DOCS))).collect()
    begun = time.time()
    got = secret_scan.report(secret_scan.scan(frame(rows, DOCS))).collect()
    assert time.time() - begun < 40 and len(got) == 5
    assert {r["doc_id"]: r["spans"] for r in got} == {d: ",".join(f"{k}:{a}:{b}" for a, _, k, b, _ in brute_spans(t)) if d != 1 else "" for d, t, *_ in rows}


def test_secret_redaction(frame):
    df = frame(secret_rows(), DOCS)
    out = {r["doc_id"]: r for r in secret_scan.redact(df).collect()}
    assert secret_scan.redact(df).columns == df.columns and secret_scan.redact(df).count() == df.count()
    assert out[1]["text"] == "token = '[secret:assign]' and x" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[3]["text"] == ""
    assert KEY in out[10]["text"]
    assert "deadbeef" not in out[20]["text"] and "0123456789" not in out[20]["text"]
    assert "apikey=[secret:assign] apikey=[secret:assign]" in out[30]["text"] and not re.search(r"\d{6}", out[30]["text"])
    assert secret_scan.redact(frame([], DOCS)).collect() == [] and secret_scan.scan(frame([], DOCS)).collect() == []


def test_secret_in_copies_of_one_text(spark, frame):
    """A credential known from one text only is live however many sources copied it."""
    import corpus_pipeline
    key, other = "ghp_" + "a1B2" * 10, "ghp_" + "c3D4" * 10
    rows = [(i, f"my key {key}", "en", f"s{i}", 0) for i in range(40)] + [(100 + i, f"sample {i} {other}", "en", f"s{i}", 0) for i in range(3)]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_secrets(spark, frame(rows, DOCS), "").collect()}
    assert len(out) == len(rows) and all(out[i] == "my key [secret:forge]" for i in range(40))
    assert all(other in out[100 + i] for i in range(3))


def test_secret_dense_texts(frame):
    """Numbers of matches around the length of a run of prefix sums."""
    rng = random.Random(3)
    run = secret_scan.RUN
    rows = []
    for i, n in enumerate((run - 1, run, run + 1, 3 * run, 3 * run + 5)):
        keys = [rng.choice(["token=", "é password: ", "ü "]) + "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([4, 30]))) for _ in range(n)]
        rows.append((i, " ".join(keys), "s", "en", 0))
    df = frame(rows, "doc_id long, text string, source string, lang string, n_chars int")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.report(secret_scan.scan(df)).collect()}
    out = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    for i, text, *_ in rows:
        spans = brute_spans(text)
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, _, k, b, _ in spans)
        # values in order; one that begins inside another goes with it
        want, at = "", 0
        for a, b, kind in sorted(((b - len(v), b, k) for _, _, k, b, v in spans), key=lambda v: (v[0], -v[1])):
            if a >= at:
                want += text[at:a] + f"[secret:{kind}]"
            at = max(at, b)
        assert out[i] == want + text[at:]


def test_secret_main_path_has_no_python(frame):
    plan = secret_scan.report(secret_scan.scan(frame(secret_rows(), DOCS)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- byte-level BPE ---------------------------------------------------------

def test_bpe_round_trip(frame, corpus):
    import tiktoken
    path, pattern = rank_file()
    ranks = open(path, "rb").read()
    plain = bpe.Codec(ranks, pattern).encoding
    assert isinstance(plain, tiktoken.Encoding)
    hard = [(900, "Don't  stop\n\n now 123 \u00a0 ça été <|endoftext|>", "fr", "s", 0), (901, "ab" * 40000, "en", "s", 0), (902, "x" + " " * 30000 + "y", "en", "s", 0),
            (903, " ".join(words(9000, 4)) + " it's " * 3000, "en", "s", 0), (904, "\x00\u2028漢字😀", "zh", "s", 0)]
    rows = corpus + hard
    got = bpe.decode(bpe.encode(frame(rows, DOCS), path, pattern), path, pattern).collect()
    once = bpe.encode(frame(rows, DOCS), path, pattern, decoded=True).collect()
    assert Counter(map(str, once)) == Counter(map(str, got))
    text = Counter((r[0], r[1] or "") for r in rows)
    assert Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in got) == text
    for r in got:
        t = bytes(r["decoded"]).decode()
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["n_tokens"] and ids == plain.encode_ordinary(t)
    assert bpe.encode(frame([], DOCS), path, pattern).collect() == []


def test_bpe_boundaries(monkeypatch):
    """Cut anywhere that is safe, the ids stay."""
    path, pattern = rank_file()
    codec = bpe.Codec(open(path, "rb").read(), pattern)
    rng = random.Random(2)
    text = "".join(rng.choice(["a", "bc", " ", "  ", "'s", "'", "7", "é", "\n", " the", ".", "ll"]) for _ in range(4000))
    want = codec.encoding.encode_ordinary(text)
    for n in (1, 2, 5, 17, 400):
        monkeypatch.setattr(bpe, "PIECE_CHARS", n)
        assert codec.encode(text) == want


# ---- token counts -----------------------------------------------------------

def brute_tokens(word, scores, byte):
    text = token_counts.MARK + word
    best = [(0.0, 0)] + [None] * len(text)
    for d in range(1, len(text) + 1):
        size = len(text[d - 1].encode())
        options = [(best[d - 1][0] + size * byte, -(best[d - 1][1] + size))]
        for a in range(d):
            if text[a:d] in scores:
                options.append((best[a][0] + scores[text[a:d]], -(best[a][1] + 1)))
        top = max(options)
        best[d] = (top[0], -top[1])
    return best[-1][1], best[-1][0]


def test_token_counts(frame, corpus):
    import public_tokenizers
    path = public_tokenizers.path(PIECE_MODEL)
    scores, byte = token_counts.vocabulary(open(path, "rb").read())
    rows = corpus + [(900, "漢字 naïve 😀 " + "q" * 3000, "x", "s", 0)]
    got = token_counts.token_counts(frame(rows, DOCS), path).collect()
    memo = {}
    want = Counter()
    for d, t, *_ in rows:
        ws = (t or "").split()
        for w in set(ws):
            if w not in memo:
                memo[w] = brute_tokens(w, scores, byte)
        want[(d, len(ws), sum(memo[w][0] for w in ws), round(sum(memo[w][1] for w in ws), 4))] += 1
    assert Counter((r["doc_id"], r["n_pretokens"], r["n_tokens"], round(r["score"], 4)) for r in got) == want
    assert token_counts.token_counts(frame([], DOCS), path).collect() == []


def test_token_counts_keep_white_space(frame, corpus):
    """The whole raw text, white space included, against one table over all of it."""
    import public_tokenizers
    path = public_tokenizers.path(PIECE_MODEL)
    scores, byte = token_counts.vocabulary(open(path, "rb").read())
    texts = ["a\n\nb  c", "def f():\n\tif x:\n        return  1 \n\n\n", " ", "\n", "  lead", "tail ", "a\r\nb\r\r\n", "a \t b", "x" + " " * 37 + "y", "a\u00a0b \u2028 c", "a\u2581b", "\x0b\x0c z\x00", "", None,
             *[t[:400] for _, t, *_ in corpus[:4]]]
    got = {r["doc_id"]: r for r in token_counts.token_counts(frame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS), path, words_only=False).collect()}
    for i, t in enumerate(texts):
        n, score = brute_tokens(t.replace(" ", token_counts.MARK), scores, byte) if t else (0, 0.0)
        assert (got[i]["n_pretokens"], got[i]["n_tokens"], round(got[i]["score"], 4)) == (len((t or "").split()), n, round(score, 4)), t
    assert got[0]["n_tokens"] == 6 and got[2]["n_tokens"] == 1 and got[3]["n_tokens"] == 2
    assert token_counts.pretoken_pattern({"a": 0.0}).findall("▁a\n\n▁▁b\tc") == ["▁a", "\n\n", "▁▁b", "\t", "c"]
    for other in ({"▁a▁b": 0.0}, {"▁a▁b": 0.0, "\t\n\v\f\r": 0.0}):  # pieces that cross words or hold every break
        cuts = token_counts.pretoken_pattern(other).findall("▁a▁b\nc")
        assert "".join(cuts) == "▁a▁b\nc" and cuts[0].startswith("▁a▁b")


# ---- quality ----------------------------------------------------------------

def test_quality(spark, frame):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in scored])
    good, bad = ([r["score"] for r in scored if r["quality"] == q] for q in (1, 0))
    auc = np.mean([g > b for g in good for b in bad])
    assert right > 0.9 and auc > 0.97
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n ", "en", "s", 0), (4, "a" * 10 ** 6, "en", "s", 0), (4, "a" * 10 ** 6, "en", "s", 0), (None, "x\ny", "en", "s", 0)]
    got = quality.score(frame(odd, DOCS), model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_good(frame(odd, DOCS), model)
    assert kept.columns == frame(odd, DOCS).columns and kept.count() == sum(r["predicted"] for r in got)
    assert quality.score(frame([], DOCS), model).collect() == []
    none = quality.fit(frame(odd, DOCS), spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(frame(odd, DOCS), none).collect()} == {0.5}


def test_held_out_rule(spark):
    import zlib
    got = {r[0]: r[1] for r in spark.range(50).select("id", quality.held_out(F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_tree_walk():
    """Flattened trees give what a row-by-row walk gives."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality.fit_trees(x, y, trees=25, depth=3)
    p = quality.predict(m, x)
    assert np.mean((p > 0.5) == y) > 0.95
    for i in range(0, 600, 37):
        s = m["bias"]
        for root in m["roots"]:
            node = root
            while m["feature"][node] >= 0:
                node = m["left"][node] + (x[i, m["feature"][node]] > m["threshold"][node])
            s += m["threshold"][node]
        assert p[i] == pytest.approx(1 / (1 + np.exp(-s)))


# ---- decontamination --------------------------------------------------------

def semi_global(p, t, free=True):
    prev, best, end = list(range(len(p) + 1)), len(p), 0
    for j, c in enumerate(t):
        cur = [0 if free else j + 1]
        for i in range(1, len(p) + 1):
            cur.append(min(prev[i - 1] + (p[i - 1] != c), prev[i] + 1, cur[i - 1] + 1))
        if cur[-1] < best:
            best, end = cur[-1], j + 1
        prev = cur
    return best, end


def test_myers():
    rng = random.Random(0)
    for _ in range(1500):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert decontam.myers(decontam.masks(p), len(p), t) == semi_global(p, t)
        assert decontam.myers(decontam.masks(p), len(p), t, True) == semi_global(p, t, False)


def edited(s, k, rng):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        r = rng.randrange(3)
        if r == 0:
            s[i] = rng.choice("xyz")
        elif r == 1:
            del s[i]
        else:
            s.insert(i, rng.choice("xyz"))
    return "".join(s)


def test_decontamination(frame, spark):
    rng = random.Random(7)
    items = [(i, " ".join(words(rng.randint(6, 40), 5000 + i))) for i in range(12)] + [(50, "short it"), (51, None), (52, ""), (53, "Straße  Éa  " + " ".join(words(8, 1))), (0, "same id " + " ".join(words(9, 77)))]
    docs = []
    for d in range(150):
        ident, item = rng.choice(items[:12])
        e = decontam.budget(len(item), decontam.ERROR)
        body = edited(item, rng.randint(0, 2 * e), rng) if d % 3 else ""
        docs.append((d, " ".join(words(30, d)) + " " + body.upper() + "\n\n" + " ".join(words(10, -d - 1)), "en", "s", 0))
    docs += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, "x short  IT y", "en", "s", 0), (203, "xshort it", "en", "s", 0), (204, "a STRASSE éA straße éa\t" + " ".join(words(8, 1)), "en", "s", 0), docs[1],
             (None, docs[1][1], "en", "s", 0)]
    got = decontam.find_items(frame(docs, DOCS), frame(items, "item_id long, text string")).collect()
    want = set()
    for d, t, *_ in docs:
        s = decontam.normal(t or "")
        for ident, item in items:
            p = decontam.normal(item or "")
            if not p:
                continue
            if len(p) < decontam.SHORT:
                if re.search(r"(?<!\w)" + re.escape(p) + r"(?!\w)", s):
                    want.add((d, ident, 0))
                continue
            dist, _ = semi_global(p, s)
            if dist <= decontam.budget(len(p), decontam.ERROR):
                want.add((d, ident, dist))
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want and len(want) > 30
    text = {d: t for d, t, *_ in docs}
    for r in got:
        part = decontam.normal(text[r["doc_id"]][r["start"]: r["end"]])
        assert any(semi_global(part, decontam.normal(t), False)[0] <= r["distance"] or semi_global(decontam.normal(t), part)[0] == r["distance"] for i, t in items if i == r["item_id"])
    kept = decontam.drop_contaminated(frame(docs, DOCS), frame(items, "item_id long, text string"))
    flagged = {d for d, *_ in want}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, *_ in docs if d not in flagged), key=str)
    assert decontam.find_items(frame(docs, DOCS), frame([], "item_id long, text string")).collect() == []
    assert decontam.find_items(frame([], DOCS), frame(items, "item_id long, text string")).collect() == []


def test_decontamination_in_blocks(frame, monkeypatch):
    """Items in many blocks are found as in one."""
    items = [(i, " ".join(words(12, 6000 + i))) for i in range(9)]
    docs = [(d, " ".join(words(20, d)) + " " + items[d % 9][1], "en", "s", 0) for d in range(40)]
    one = decontam.find_items(frame(docs, DOCS), frame(items, "item_id long, text string")).collect()
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 150)
    many = decontam.find_items(frame(docs, DOCS), frame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 40
