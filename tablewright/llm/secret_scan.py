"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions.

Candidates are regular-expression matches (three base kinds and some provider
formats).  Each candidate value is hashed; a value found with many distinct
owners and repositories is a widely copied example (documentation keys, sample
configurations), one that stays with few is a live-looking credential.  Base
spans are always reported; spans of the added kinds only when live.

A text is matched once, a row at a time; what follows works on hashes.  The
candidates of one text are one array, those of the corpus never are: ownership
is counted from distinct (hash, owner, repository) rows, combined map-side.

Null texts are empty, a null owner or repository counts as one unknown owner or
repository, rows that repeat are scanned each on its own, an empty table gives
an empty result, and other columns are ignored (scan) or kept (redact).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stage, with_id

#: A value with this many distinct owners and repositories is an example.
MIN_OWNERS = MIN_REPOSITORIES = 3


def any_case(word: str) -> str:
    """A pattern for the ASCII letters of ``word`` in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, group that holds the value, least length of that group; the order breaks ties.
BASE = [
    ("assign", ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]
#: Kinds that the method adds.
ADDED = [
    ("forge", "gh[opsur]_[A-Za-z0-9]+", 0, 40),
    ("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    ("jwt", r"(?:^|[^A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 30),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]
#: Patterns that Spark runs instead, with the same values as whole matches.  Where every match is a run of one class, the
#: least length is part of the pattern; a token is tried once, where its run of characters begins, and never backed out of.
RUNS = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}",
        "jwt": r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"}


#: Entries that one step of ``before`` handles.
RUN = 128


def _running(values: Column, op) -> Column:
    """0, then ``op`` over the first, the first two, ... entries."""
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))


def before(values: Column, op) -> Column:
    """For each entry of an array of non-negative integers: ``op`` (sum or
    maximum) over all entries before it, 0 for the first.  Runs of RUN entries
    are taken on their own, then shifted by what came before the run, so the
    cost is RUN steps an entry, not the array's length."""
    def in_runs(v: Column) -> Column:
        count = F.floor(F.size(v) / RUN).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda i: _running(F.slice(v, i * RUN + 1, F.lit(RUN)), op))

    def shifted(sums: Column) -> Column:
        total = _running(F.transform(sums, lambda r: F.element_at(r, -1)), op)
        both = F.arrays_zip(sums.alias("own"), F.slice(total, 1, F.size(sums)).alias("base"))
        return F.flatten(F.transform(both, lambda z: F.transform(F.slice(z["own"], 1, F.size(z["own"]) - 1), lambda v: op(z["base"], v))))

    return _once(_once(values, in_runs), shifted)


def _once(value: Column, fn) -> Column:
    """``fn(value)`` with the value worked out once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def matches(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, ord, kind, from, value>> of one kind: leftmost
    non-overlapping matches whose group is long enough.  ``from``: where the
    value begins."""
    pattern, group = (RUNS[kind], 0) if kind in RUNS else (pattern, group)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    pieces = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("hit"), value.alias("value"))
    sizes = F.transform(pieces, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), x["value"].alias("value")))
    placed = _once(sizes, lambda v: F.arrays_zip(v.alias("x"), before(F.transform(v, lambda x: x["gap"] + x["hit"]), lambda a, b: a + b).alias("at")))

    def one(p: Column) -> Column:
        begin = p["at"] + p["x"]["gap"]
        end = begin + p["x"]["hit"]
        return F.struct(begin.alias("start"), end.alias("end"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"),
                        (end - F.length(p["x"]["value"])).alias("from"), p["x"]["value"].alias("value"))

    found = F.transform(F.filter(placed, lambda p: F.length(p["x"]["value"]) >= least), one)
    none = F.array().cast("array<struct<start:int,end:int,ord:int,kind:string,from:int,value:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def candidates(text: Column) -> Column:
    """All matches of a text by start, then kind; the value as a hash only."""
    kinds = [matches(text, kind, i, p, g, n) for i, (kind, p, g, n) in enumerate(BASE + ADDED)]
    return F.transform(F.sort_array(F.concat(*kinds)), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["ord"].alias("ord"), x["kind"].alias("kind"), x["from"].alias("from"),
        F.sha2(x["value"], 256).alias("hash")))


def _text(df: DataFrame, text_col: str) -> Column:
    with_id(df, text_col)
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _examples(found: DataFrame, min_owners: int, min_repositories: int, by_text: bool = False) -> DataFrame:
    """(rid, examples): for each scanned row the hashes among its candidates
    that are widely copied.  ``by_text``: rows of one text (column ``body``)
    are one document, owned by the smallest of their owners."""
    own = found.where("size(found) > 0").select("rid", "owner", "repo", *["body"] * by_text, F.explode(F.array_distinct(F.col("found.hash"))).alias("hash"))
    owned = own.groupBy("hash", "body").agg(F.min(F.struct("owner", "repo")).alias("o")).select("hash", "o.*") if by_text else own
    wide = (owned.select("hash", "owner", "repo").distinct().groupBy("hash")
            .agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"))
            .where((F.col("owners") >= min_owners) & (F.col("repos") >= min_repositories)).select("hash"))
    wide = stage(wide, "secret-examples")
    return own.select("rid", "hash").join(wide, "hash").groupBy("rid").agg(F.collect_set("hash").alias("examples"))


def _owners(df: DataFrame, owner_col: str, repo_cols: list[str]) -> list[Column]:
    part = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("")
    return [part(owner_col).alias("owner"), F.to_json(F.array(*[part(c) for c in repo_cols])).alias("repo")]


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_cols: tuple[str, ...] = ("source", "lang"), min_owners: int = MIN_OWNERS, min_repositories: int = MIN_REPOSITORIES,
         by_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, spans (array of start, end, kind, whether
    the value is live; code points, end exclusive).  Copies of one text count as
    one document, unless ``by_text`` is off; time follows a text's length,
    whatever is in it."""
    body = [F.sha2(_text(df, text_col), 256).alias("body")] if by_text else []
    found = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
                      *_owners(df, owner_col, list(repo_cols)), *body, candidates(_text(df, text_col)).alias("found"))
    found = stage(found, "secret-found")
    wide = _examples(found, min_owners, min_repositories, by_text)
    known = F.coalesce(F.col("examples"), F.array().cast("array<string>"))
    with_live = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["ord"].alias("ord"), x["kind"].alias("kind"),
                                                        x["from"].alias("from"), (~F.array_contains(known, x["hash"])).alias("live")))
    kept = F.filter(with_live, lambda x: (x["ord"] < len(BASE)) | x["live"])
    plain = found.where("size(found) = 0").withColumn("examples", F.lit(None).cast("array<string>"))
    hit = found.where("size(found) > 0").join(wide, "rid", "left").select(plain.columns)
    return hit.unionByName(plain).select("doc_id", kept.alias("spans"))


def report(spans: DataFrame) -> DataFrame:
    """The digest columns of ``scan``'s result."""
    base = F.filter("spans", lambda x: x["ord"] < len(BASE))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(
        "doc_id", *[n(k) for k, *_ in BASE], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_example"))


def redact(df: DataFrame, text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"),
           min_owners: int = MIN_OWNERS, min_repositories: int = MIN_REPOSITORIES, by_text: bool = False) -> DataFrame:
    """``df`` with the values of live spans replaced by ``[secret:KIND]``; a
    column ``n_chars`` follows the text.  Widely copied examples stay; with
    ``by_text`` copies of one text count as one document, so what is only in
    them goes.  Only rows with candidates are shuffled."""
    body = [F.sha2(_text(df, text_col), 256).alias("body")] if by_text else []
    full = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"), F.monotonically_increasing_id().alias("rid"),
                     *_owners(df, owner_col, list(repo_cols)), *body, candidates(_text(df, text_col)).alias("found"))
    full = stage(full, "secret-rows")
    wide = stage(_examples(full.select("rid", "owner", "repo", *["body"] * by_text, "found"), min_owners, min_repositories, by_text), "secret-wide")
    hit = full.where("size(found) > 0").join(wide, "rid", "left")
    known = F.coalesce(F.col("examples"), F.array().cast("array<string>"))
    live = F.filter("found", lambda x: ~F.array_contains(known, x["hash"]))
    text = F.col("r")[text_col].cast("string")
    by_value = F.array_sort(live, lambda a, b: F.when(a["from"] != b["from"], a["from"] - b["from"]).otherwise(b["end"] - a["end"]))
    # how far the values before each one reach; a value that begins inside another goes with it
    hit = hit.withColumn("ordered", by_value)
    hit = hit.withColumn("reach", before(F.col("ordered.end"), lambda a, b: F.greatest(a, b)))
    kept = F.filter(F.arrays_zip("ordered", "reach"), lambda z: z["ordered"]["from"] >= z["reach"])

    def rewritten(run: Column) -> Column:
        # positions count from the run's own stretch of text, so a long text isn't walked once a value
        first = run[0]["reach"]
        stretch = text.substr(first + 1, F.element_at(run, -1)["ordered"]["from"] - first)
        return _once(stretch, lambda t: F.array_join(F.transform(run, lambda z: F.concat(
            t.substr(z["reach"] - first + 1, z["ordered"]["from"] - z["reach"]), F.lit("[secret:"), z["ordered"]["kind"], F.lit("]"))), ""))

    cut = _once(kept, lambda v: F.transform(F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / RUN).cast("int")),
                                                                 lambda i: F.slice(v, i * RUN + 1, F.lit(RUN))), lambda run: F.size(run) > 0), rewritten))
    new = F.concat(F.array_join(cut, ""), text.substr(F.coalesce(F.array_max("ordered.end"), F.lit(0)) + 1, F.length(text)))
    changed = hit.withColumn("n", F.size(live)).withColumn("t", F.when(F.col("n") > 0, new).otherwise(text))

    def column(c: str) -> Column:
        old = F.col("r")[c]
        if c == text_col:
            return F.coalesce(F.col("t"), old).alias(c)
        if c == "n_chars" and c != text_col:
            return F.when(F.col("n") > 0, F.length("t")).otherwise(old).cast(df.schema[c].dataType).alias(c)
        return old.alias(c)

    plain = full.where("size(found) = 0").select(*[F.col("r")[c].alias(c) for c in df.columns])
    return changed.select(*[column(c) for c in df.columns]).unionByName(plain)
