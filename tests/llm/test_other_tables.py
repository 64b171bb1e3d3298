"""Vectors, conversations, URLs and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tablewright.llm import ann, chat_format, decontam, url_filter
from tests.conftest import SF001, SF0001

VECTORS = "vec_id long, embedding array<float>"


def brute_nearest(rows, k, ask):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = Counter(len(v) for _, v in ok).most_common(1)[0][0]
    ok = [(i, v) for i, v in ok if len(v) == size]
    out = {}
    for q, x in ok:
        if ask(q):
            best = sorted(((-float(x @ v), i) for i, v in ok if i != q))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


@pytest.mark.parametrize("list_rows", [16, 10_000])
def test_nearest(frame, list_rows, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 90)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(6, 24)) * 2
    rows = [(i, (centers[i % 6] + rng.normal(size=24)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [1.0] * 23 + [None]), (2060, [float("nan")] * 24), (2080, [float("inf")] + [1.0] * 23), (2100, [1.0] * 5), (2120, []), (None, rows[3][1])]
    got = defaultdict(list)
    for r in ann.nearest(frame(rows, VECTORS), F.col("id") % 20 == 0, 20, list_rows=list_rows).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(rows, 20, lambda i: i % 20 == 0)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 21))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for i, _ in best})
    assert hits / sum(map(len, want.values())) > 0.97


def test_nearest_of_few(frame):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [-1.0, 2.0])]
    got = [tuple(r) for r in ann.nearest(frame(rows, VECTORS), F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert ann.nearest(frame([], VECTORS), F.col("id") % 20 == 0).collect() == []
    assert ann.nearest(frame([(0, None)], VECTORS), F.col("id") % 20 == 0).collect() == []


def test_nearest_recall_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute_nearest(rows, 20, lambda i: i % 20 == 0)
    got = defaultdict(set)
    for r in E.queries()["op3_one_bit_neighbours"](spark, SF001).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert np.mean([len(got[q] & {i for i, _ in b}) / len(b) for q, b in want.items()]) > 0.97


# ---- chat ---------------------------------------------------------------------

def test_chat_round_trip(frame):
    rng = random.Random(0)
    parts = ["<|turn|>", "<|text|>", "<|end|>", "<", "|", "\\", "<\\|", "<\\\\|", "a", "é😀", "\n", "</s>[INST]", ">"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a<|end|>b", None, "x\ny"]), rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))]))
            for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "null id"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (8, None, "assistant", "no turn"), (9, 99, "assistant", "long " * 50000)]
    rng.shuffle(rows)
    df = frame(rows, "conv_id long, turn long, role string, text string")
    back = chat_format.read_back(chat_format.format_conversations(df))
    got = {r["conv_id"]: r for r in chat_format.digest(back).collect()}
    full = {r["conv_id"]: r for r in back.collect()}
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert [(m["role"], t) for m in full[c]["merged"] for t in m["texts"]] == turns
        assert all(a["role"] != b["role"] for a, b in zip(full[c]["merged"], full[c]["merged"][1:]))
        r = got[c]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss) and r["formatted_chars"] == len(full[c]["formatted"])
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_conversations(frame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("name", ["op2_secret_ownership", "op4_relational_chat"])
def test_native_queries_have_no_python(spark, name):
    plan = E.queries()[name](spark, SF0001)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- URLs ---------------------------------------------------------------------

def brute_url(u):
    u = u or ""
    rest = u.split("://", 1)[1] if "://" in u else ""
    cut = lambda s, chars: s[: min([s.find(c) for c in chars if c in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host):], "?#")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return host, path, best


def test_urls(frame):
    urls = [None, "", "no scheme/net/", "http://", "http://a.net", "http://a.net/", "HTTP://WWW.Example.NET/en/1?x#y", "http://xexample.net/en/1", "http://example.com/de/", "http://m.example.com/fr/", "http://a.org/fr/9",
            "http://org/fr/", "http://a.com/p?utm_source=feed", "https://www.a.com/p/", "http://a.com/p.html#top", "http://a.com/p?b=1&a=2&utm_x=1", "http://a.com/p?a=2&ref=z&b=1", "http://É.com/é?q", "http://a.com/q",
            "x://y://z/net", "http://a.com/" + "p" * 100000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(i, "http://hot.com/same") for i in range(100, 160)] + [(200, "http://hot.com/same/?utm_a=1"), (None, "http://hot.com/same")]
    pages = frame(rows, "page_id long, url string")
    for blocks in (None, 1, url_filter.BLOCKS):  # one block: the filter passes nearly everything, the join decides
        got = url_filter.filter_urls(pages, url_filter.tracked(pages), blocks=blocks).collect()
        assert Counter(r["page_id"] for r in got) == Counter(i for i, _ in rows)
        listed = {"http://a.com/p?utm_source=feed", "https://www.a.com/p/", "http://a.com/p.html#top", "http://a.com/p?b=1&a=2&utm_x=1", "http://a.com/p?a=2&ref=z&b=1", "http://hot.com/same", "http://hot.com/same/?utm_a=1"}
        for r in got:
            u = dict(rows)[r["page_id"]]
            host, path, best = brute_url(u)
            assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
            assert r["verdict"] == (best[0] if best else "block" if u in listed else "allow")
    assert url_filter.filter_urls(pages, url_filter.tracked(pages.limit(0))).where("listed").count() == 0
    assert url_filter.filter_urls(pages.limit(0), url_filter.tracked(pages)).collect() == []


def test_filter_follows_the_list(spark):
    """Blocks grow with the list up to the bound; few unlisted keys pass."""
    assert [url_filter.blocks_for(n) for n in (0, 1, 16, 17, 1000, 10**12)] == [1, 1, 1, 2, 64, url_filter.BLOCKS]
    for n in (10, 3000, 40000):
        listed = spark.range(n).selectExpr("concat('h/', id) AS k")
        blocks = url_filter.blocks_for(n)
        filt = {r["block"]: r for r in url_filter.bloom(listed, "k", blocks).collect()}
        assert len(filt) <= blocks

        def passed(df):
            keys = df.select(*[c.alias(name) for name, c in url_filter._bits("k", blocks).items()]).collect()
            return sum(r["block"] in filt and all(filt[r["block"]][f"w{i}"] & r[f"b{i}"] for i in range(8)) for r in keys)
        assert passed(listed) == n and passed(spark.range(20000).selectExpr("concat('other/', id) AS k")) <= 200


# ---- pipeline -----------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline as P
    from tests.llm.test_text_operators import brute_components, brute_spans
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    frames = [docs]
    for _, step in P.STAGES:
        out = P.stage(step(spark, frames[-1], SF0001), "test-pipeline")
        frames.append(out)
    for f in frames[:-1]:
        assert f.columns == docs.columns
    rows = [[tuple(r) for r in f.collect()] for f in frames]
    kept = brute_components(rows[1])
    assert sorted(rows[2]) == sorted(r for r in rows[1] if kept[r[0]][1] == r[0])
    items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    clean = [r for r in rows[2] if not any(i in decontam.normal(r[1]) for i in items)]
    assert set(rows[3]) <= set(clean) and len(rows[3]) >= len(clean) - 2
    owners = defaultdict(set)
    for r in rows[3]:
        for *_, v in brute_spans(r[1]):
            owners[v].add((r[3], r[2]))
    after = {r[0]: r for r in rows[4]}
    for r in rows[3]:
        live = [v for *_, v in brute_spans(r[1]) if len({a for a, _ in owners[v]}) < 3]
        if live:
            assert not any(v in after[r[0]][1] for v in live) and after[r[0]][4] == len(after[r[0]][1])
        else:
            assert after[r[0]] == r
    final = {r[0]: r for r in rows[5]}
    assert set(final) == set(after) and all(final[d][4] == hashlib.sha256(after[d][1].encode()).hexdigest() for d in after)
    assert P.run(spark, SF0001).count() == len(final)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_removes_copies_by_row(spark, frame):
    """Repeated and missing ids: of each group one row stays, and no other text goes."""
    import corpus_pipeline as P
    from tests.llm.test_text_operators import words
    a, b, c, d = (" ".join(words(60, seed)) for seed in (1, 2, 3, 4))
    rows = [(1, a), (5, a + " end"), (5, b), (7, b), (None, c), (None, c), (9, d), (9, d), (None, a), (3, None), (3, ""), (4, "x"), (4, "x")]
    df = frame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("_row", F.lit("extra"))
    out = P.deduplicate(spark, df, "")
    assert out.columns == df.columns and {r["_row"] for r in out.collect()} == {"extra"}
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (5, b), (None, c), (9, d), (3, None), (3, ""), (4, "x")], key=str)


def test_pipeline_edge_rows(spark, frame):
    """No rows, and null, empty, very long and repeated ones, through all stages."""
    import corpus_pipeline as P
    from tests.llm.test_text_operators import words
    long = " ".join(words(60000, 9)) + " token=abcdef123456"
    rows = [(1, None), (1, ""), (None, " ".join(words(80, 5))), (2, long), (2, long), (3, "short")]
    for n in (0, len(rows)):
        docs = frame([(i, t, "en", "s", 0) for i, t in rows[:n]], DOCS)
        for name, step in P.STAGES[1:]:
            docs = P.stage(step(spark, docs, SF0001), "test-edges")
            if name == "secret scans" and n:
                assert [r["text"] for r in docs.where("doc_id = 2").collect()] == [long.replace("abcdef123456", "[secret:assign]")]
        assert docs.count() == (5 if n else 0)
    none = frame([], DOCS)
    assert P.classify(spark, none, SF0001).collect() == []


@pytest.mark.parametrize("name", sorted(k for k in E.queries() if k.startswith("op")))
def test_registered(spark, name):
    """Every query keeps a row for each row it judges."""
    n = E.queries()[name](spark, SF0001).count()
    table = {"op3": "embeddings", "op4": "conversations", "op8": "pages"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{SF0001}/{table}.parquet")
    if name.startswith("op3"):
        assert n == 20 * rows.where("vec_id % 20 = 0").count()
    elif name.startswith("op4"):
        assert n == rows.select("conv_id").distinct().count() + 1
    elif not name.startswith("op10"):
        assert n == rows.count()
