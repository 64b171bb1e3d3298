"""The registered queries of this subpackage: one per operator, over whole
tables, with production parameters.  ``SQL`` has the DuckDB text where one can
state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import ann, bpe, chat_format, decontam, exact_dedup, jaccard, quality, ranked_search, runs, secret_scan, sharding, token_counts, url_filter
from tablewright.llm.common import table

#: Vocabulary files: parameters of the two tokenizer queries.
RANK_FILE, PIECE_MODEL = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.digest(sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), 8), "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op4_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    extra = extra.select("conv_id", "t.turn", "t.role", F.lit(probe).alias("text"))
    return chat_format.digest(chat_format.read_back(chat_format.format_conversations(rows.unionByName(extra))))


def op5_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def rank_file() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encode(table(spark, sf_dir, "documents"), *rank_file(), decoded=True)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL), words_only=False)


def op8_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.tracked(pages))


def op9_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(runs.with_periodic_tails(table(spark, sf_dir, "documents"))))


def op12_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op13_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_hypergeometric_shards, op2_secret_ownership, op3_one_bit_neighbours, op4_relational_chat, op5_partenum_jaccard,
    op6_byte_bpe, op7_unigram_counts, op8_bloom_urls, op9_boosted_quality, op10_pigeonhole_decontamination,
    op11_grammar_runs, op12_chunk_recipes, op13_reversed_search)}


# ---- DuckDB texts ----------------------------------------------------------

def _secret_sql() -> str:
    kinds = secret_scan.BASE + secret_scan.ADDED
    q = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(f"""
      SELECT doc_id, {i} AS ord, '{kind}' AS kind, start{" + length(hit) - length(value)" if kind == "jwt" else ""} AS start, start + length(hit) AS stop, value FROM (
        SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY idx) - length(hit) AS BIGINT) AS start FROM (
          SELECT doc_id, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS idx FROM (
            SELECT doc_id, regexp_extract_all(text, {q(p)}, 0) AS hits, regexp_extract_all(text, {q(p)}, {g}) AS vals,
                   string_split_regex(text, {q(p)}) AS gaps FROM docs WHERE regexp_matches(text, {q(p)}))))
      WHERE length(value) >= {n}""" for i, (kind, p, g, n) in enumerate(kinds))
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents),
    found AS ({each}),
    once AS (SELECT value, min({{'owner': owner, 'repo': repo}}) AS o FROM found JOIN docs USING (doc_id) GROUP BY value, text),
    wide AS (SELECT value FROM (SELECT value, o.owner AS owner, o.repo AS repo FROM once) GROUP BY value
             HAVING count(DISTINCT owner) >= {secret_scan.MIN_OWNERS} AND count(DISTINCT repo) >= {secret_scan.MIN_REPOSITORIES}),
    judged AS (SELECT f.*, w.value IS NULL AS live FROM found f LEFT JOIN wide w ON f.value = w.value),
    kept AS (SELECT *, kind || ':' || start || ':' || stop AS txt FROM judged WHERE ord < {len(secret_scan.BASE)} OR live),
    per AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in secret_scan.BASE)},
                   string_agg(txt, ',' ORDER BY start, ord) FILTER (ord < {len(secret_scan.BASE)}) AS base, string_agg(txt, ',' ORDER BY start, ord) AS spans,
                   count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM kept GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
    FROM docs d LEFT JOIN per USING (doc_id)"""


CHAT_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, before IS NULL OR before <> role AS opens,
        length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 8 +
        CASE WHEN before IS NULL OR before <> role THEN 15 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) ELSE 0 END AS chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (opens) AS n_merged
FROM p GROUP BY conv_id"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
hit AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM hit JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 75 * (nu.n + nv.n - c)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM reach r JOIN edge e ON e.u = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(root) AS root FROM reach GROUP BY v) r ON r.v = d.doc_id"""

URL_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM p),
k AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS kept FROM h),
c AS (SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '(\.html|/+)$', '') ||
               CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canon FROM k),
l AS (SELECT DISTINCT canon AS listed FROM c WHERE canon <> '' AND regexp_matches(rest, '^[^?#]*\?([^#]*&)?utm_')),
r AS (SELECT page_id, host, path, listed IS NOT NULL AS listed, CASE
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM c LEFT JOIN l ON c.canon = l.listed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r"""



def _runs_sql() -> str:
    """Runs by naming: every stretch of G = 1, 2, 4, ... words gets a number
    (dense_rank of its halves).  A run with a period in (G/2, G] has 2 G equal
    words or more, and inside it a stretch of G words recurs first one period
    later, so islands of starts with one such distance are the runs."""
    names, islands = [], []
    for j in range(18):
        g = 1 << j
        if j:
            names.append(f"""n{j} AS MATERIALIZED (SELECT doc_id, i, dense_rank() OVER (ORDER BY id, nx) AS id FROM
                (SELECT doc_id, i, id, lead(id, {g // 2}) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM n{j - 1}) WHERE nx IS NOT NULL)""")
        islands.append(f"""SELECT doc_id, min(i) AS s, max(i) - min(i) + {g} + q AS length, q FROM (
                SELECT doc_id, i, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM (
                    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id, id ORDER BY i) - i AS q FROM n{j}) WHERE q > {g // 2} AND q <= {g})
            GROUP BY doc_id, q, island""")
    return rf"""
    WITH ids AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                        xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                            lambda crc, c: list_reduce(range(8), lambda y, k: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, c)), 4294967295), 4294967295) AS h
                 FROM documents),
    cut AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a, h // 10 AS g FROM ids),
    per AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
    w AS MATERIALIZED (SELECT doc_id, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS word
          FROM (SELECT *, unnest(range(n)) AS i FROM per)),
    n0 AS MATERIALIZED (SELECT doc_id, i, dense_rank() OVER (ORDER BY word) AS id FROM w),
    {", ".join(names)},
    run AS MATERIALIZED (SELECT doc_id, s, length, q FROM ({" UNION ALL ".join(islands)}) WHERE length >= greatest(24, 3 * q)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM run),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS txt FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
    best AS (SELECT *, (1000 * length) // q AS milli, row_number() OVER (PARTITION BY doc_id ORDER BY length / q DESC, s, q) AS k FROM run),
    every AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS txt FROM run GROUP BY doc_id)
    SELECT d.doc_id, coalesce(e.n_runs, 0) AS n_runs, b.s AS start, b.length, b.q AS period, b.milli AS exponent_milli,
           sha256(coalesce(e.txt, '')) AS runs_sha256, sha256(coalesce(k.txt, '')) AS collapsed_sha256
    FROM documents d LEFT JOIN every e USING (doc_id) LEFT JOIN best b ON b.doc_id = d.doc_id AND b.k = 1 LEFT JOIN kept k ON k.doc_id = d.doc_id"""


RECIPES_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

SEARCH_SQL = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM cut) GROUP BY doc_id, term),
tot AS (SELECT count(*) FILTER (len(ts) > 0) AS N, CAST(sum(len(ts)) AS BIGINT) AS L FROM cut),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, tot GROUP BY term, N),
dm AS (SELECT doc_id, 10 + (90 * len(ts) * N) // L AS m FROM cut, tot WHERE len(ts) > 0),
sc AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
       FROM items JOIN tf USING (term) JOIN wt USING (term) JOIN dm USING (doc_id) GROUP BY item_id, doc_id),
rk AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM rk WHERE rank <= 10"""

SQL = {"op2_secret_ownership": _secret_sql(), "op4_relational_chat": CHAT_SQL, "op5_partenum_jaccard": JACCARD_SQL, "op8_bloom_urls": URL_SQL,
       "op11_grammar_runs": _runs_sql(), "op12_chunk_recipes": RECIPES_SQL, "op13_reversed_search": SEARCH_SQL}
