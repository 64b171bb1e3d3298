"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct 5-word shingles (64-bit hashes).  Two
documents link when 100 * |A and B| >= 75 * |A or B|, which is the same as
|A xor B| <= (|A| + |B|) / 7.

*Size bands.*  Sizes fall into bands [2^j, 2^(j+1)).  A set takes part in its
own band and, when a partner may be in the band below, in that one as well, so
both sets of any linked pair meet in the smaller one's band.

*Partitions.*  In a band the feature domain (the hash range) is cut into
n1 = 0.8 * 2^j partitions; a signature is the projection of a set on one
partition.  At most k partitions differ between linked sets, k being the
band's bound on |A xor B|, so a set with more than k occupied partitions
shares a non-empty projection with every partner.  Of a set's signatures only
the first k + 1 in a global order are emitted: everything before the first
common signature differs, on either side, hence that signature is among the
first k + 1 of both.  The order (projections with many uncommon shingles
first) decides which signatures are used, never which links are found: common
passages are used last.  A set with too few occupied partitions also joins a
finer partitioning, at the end one of single shingles; a pair could be missed
only if both its sets were short of partitions, and then both are there.

*Candidates.*  Of the rows that share a signature each is compared with the
smallest id of the group (a star, not all pairs); verified links are contracted
to components.  Groups that still hold several components are compared block
by block, leaving out pairs already in one component.  Equal sets are
represented by one row throughout.

Results: rows that share a document id are one vertex.  Rows without an id take
part in no link and get a null component.  Null or empty texts, and texts
without words, have no shingles, link with nothing and are their own component.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import id_text, slices, stage
from tablewright.llm.components import connected_components
from tablewright.llm.textvec import U, WordHasher, mix

#: Texts read for the list of common shingles, and in how many distinct ones of
#: them a shingle counts as common.  Both steer cost only.
SAMPLE_TEXTS, COMMON_IN, COMMON_MOST = 3000, 4, 1 << 17
#: Members of one signature group that are compared in one task.
BLOCK = 1024

_FEATURES = "doc_id long, n_shingles long, f1 long, f2 long, sketch binary"


def _fingerprint(h: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = mix(h ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)
        b = mix(h + U(0x51ED270B7F4A7C15)).sum(dtype=U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketch(h: np.ndarray) -> np.ndarray:
    """A parity bit for each of 2 to 4 buckets a shingle, at least 64: every
    shingle flips the bit of its top hash bits.  Two sets' sketches differ in at
    most |A xor B| bits, so too many differing bits rule a link out."""
    bits = max(6, (2 * max(len(h), 1) - 1).bit_length())
    return np.packbits((np.bincount((h >> U(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).astype(bool), bitorder="little").view("<u8")


def folded(s: np.ndarray, words: int) -> np.ndarray:
    """A sketch (or rows of them) at a lower resolution: neighbouring buckets in
    one."""
    while s.shape[-1] > words:
        bits = np.unpackbits(np.ascontiguousarray(s).view(np.uint8), axis=-1, bitorder="little")
        s = np.packbits(bits[..., ::2] ^ bits[..., 1::2], axis=-1, bitorder="little").view("<u8")
    return s


def _features(batches):
    hasher = WordHasher()
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [(len(h), *_fingerprint(h), sketch(h).tobytes()) for h in hasher.sets(part.column(1))]
            n, a, b = (pa.array([r[i] for r in rows], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([part.column(0), n, a, b, pa.array([r[3] for r in rows], pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "sketch"])


def partitions(band: int) -> int | None:
    """First-level partitions of a band; None: one for every shingle."""
    return int(0.8 * (1 << band)) if band >= 4 else None


def roles(size: int) -> list[tuple[int, int]]:
    """(band, largest symmetric difference to a partner) for a set of ``size``."""
    own = size.bit_length() - 1
    low = 1 << own
    out = [(own, size // 3)]
    if (3 * size + 3) // 4 <= low - 1:
        out.append((own - 1, (size + low - 1) // 7))
    return out


def signatures(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The signatures of one sorted set.  ``common``: sorted hashes of common
    shingles."""
    if not len(h):
        return np.zeros(0, U)
    out = []
    rare = np.ones(len(h), np.int64)
    if len(common):
        at = np.searchsorted(common, h)
        at[at == len(common)] = 0
        rare -= common[at] == h
    with np.errstate(over="ignore"):
        e = mix(h + U(0x2545F4914F6CDD1D))
        for band, k in roles(len(h)):
            n1 = partitions(band)
            for level, n in enumerate((n1, 4 * n1, None) if n1 else (None,)):
                if n:
                    seg = ((h >> U(32)) * U(n)) >> U(32)
                    at = np.concatenate(([0], np.flatnonzero(seg[1:] != seg[:-1]) + 1))
                    sums, weight = np.add.reduceat(e, at), np.add.reduceat(rare, at)
                else:
                    sums, weight = e, rare
                sig = mix(sums ^ mix(np.array([band * 4 + level + 1], U))[0])
                if len(sig) > k + 1:
                    sig = sig[np.lexsort((sig, -weight))[: k + 1]]
                out.append(sig)
                if len(sig) >= k + 1:
                    break
    return np.concatenate(out)


def _emit(common_var):
    def run(batches):
        hasher, common, seen = WordHasher(), common_var.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                sigs, refs = [], []
                for doc, h in zip(part.column(0).to_pylist(), hasher.sets(part.column(1))):
                    if not len(h):
                        continue
                    # repeats of a set within a task say nothing new (they meet by fingerprint)
                    key = (len(h), *_fingerprint(h))
                    if key in seen:
                        continue
                    seen.add(key)
                    s = signatures(h, common)
                    sigs.append(s)
                    refs.append(np.full(len(s), doc, np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).astype(np.int64)), pa.array(np.concatenate(refs))], ["sig", "ref"])
    return run


def _common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles in several distinct texts of a bounded sample (ids in hash
    order).  It only orders signatures."""
    ids = [r[0] for r in docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_TEXTS).collect()]
    if not ids:
        return np.zeros(0, U)
    few = docs.where(F.col("doc_id").isin(ids)).mapInArrow(_sampled, "h long, n long")
    rows = few.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_IN).orderBy(F.desc("n"), "h").limit(COMMON_MOST).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).astype(U))


def _sampled(batches):
    hasher, seen = WordHasher(), set()
    for batch in batches:
        for part in slices(batch, "text"):
            sets = []
            for h in hasher.sets(part.column(1)):
                key = (len(h), *_fingerprint(h))
                if key not in seen:
                    seen.add(key)
                    sets.append(h)
            if sets:
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


def _blobs(batches):
    hasher = WordHasher()
    for batch in batches:
        for part in slices(batch, "text"):
            sets = [h.tobytes() for h in hasher.sets(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= 75 * (len(x) + len(y) - both)


def _verify(batches):
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = [linked(np.frombuffer(x, U), np.frombuffer(y, U)) for x, y in zip(a, b)]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])


def can_link(n: int, m: int, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sizes and sketches leave a link possible."""
    if 4 * min(n, m) < 3 * max(n, m):
        return False
    w = min(len(a), len(b))
    return 7 * int(np.bitwise_count(folded(a, w) ^ folded(b, w)).sum()) <= n + m


def _sift(batches):
    """Pairs whose sizes and sketches leave a link possible."""
    for batch in batches:
        c = [batch.column(batch.schema.get_field_index(k)) for k in ("u", "v", "nu", "nv", "su", "sv")]
        keep = [can_link(n, m, np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) for n, m, a, b in zip(*(x.to_pylist() for x in c[2:]))]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([c[0].filter(mask), c[1].filter(mask)], ["u", "v"])


def _close_pairs(n, comp, side, sketches) -> np.ndarray:
    """Which members of one block may link with a member of another component,
    by sizes and sketches."""
    words = np.array([len(x) for x in sketches]) // 8
    table = {w: np.frombuffer(b"".join(sketches[i] for i in np.flatnonzero(words == w)), "<u8").reshape(-1, w) for w in np.unique(words).tolist()}
    wanted = np.zeros(len(n), bool)
    for w, left in table.items():
        i = np.flatnonzero(words == w)
        # linked sets differ in size by a third at most, so in resolution by one step
        for other in (w, 2 * w):
            if other not in table:
                continue
            j, right = np.flatnonzero(words == other), folded(table[other], w)
            step = max(1, (1 << 20) // (len(j) * w))
            for lo in range(0, len(i), step):
                k = i[lo: lo + step]
                total = n[k][:, None] + n[j]
                ok = (comp[k][:, None] != comp[j]) & ((side[k][:, None] != side[j]) | (side[k][:, None] == 2))
                ok &= 7 * np.minimum(n[k][:, None], n[j]) >= 3 * total
                if ok.any():
                    ok &= 7 * np.bitwise_count(left[lo: lo + step, None] ^ right[None]).sum(2, dtype=np.int64) <= total
                    wanted[k[ok.any(1)]] = True
                    wanted[j[ok.any(0)]] = True
    return wanted


def _possible(batches):
    """Rows sorted by (sig, bi, bj), a block each: those that may link with a
    member of another component.  Holds one block besides the batch."""
    names, rest = ["sig", "bi", "bj", "rep", "comp", "side"], None
    for batch in itertools.chain(batches, (None,)):
        part = batch if rest is None else rest if batch is None else pa.concat_batches([rest, batch])
        if part is None or not part.num_rows:
            continue
        col = {k: part.column(part.schema.get_field_index(k)) for k in [*names, "n", "sketch"]}
        v = {k: np.asarray(col[k]) for k in [*names, "n"]}
        new = (v["sig"][1:] != v["sig"][:-1]) | (v["bi"][1:] != v["bi"][:-1]) | (v["bj"][1:] != v["bj"][:-1])
        at = np.concatenate(([0], np.flatnonzero(new) + 1, [part.num_rows]))
        done = len(at) - 1 if batch is None else len(at) - 2
        rest = part.slice(int(at[done]))
        wanted, sketches = np.zeros(part.num_rows, bool), col["sketch"].to_pylist()
        for lo, hi in zip(at[:done].tolist(), at[1: done + 1].tolist()):
            if hi - lo > 1:
                wanted[lo:hi] = _close_pairs(v["n"][lo:hi], v["comp"][lo:hi], v["side"][lo:hi], sketches[lo:hi])
        if wanted.any():
            mask = pa.array(wanted)
            yield pa.RecordBatch.from_arrays([col[k].filter(mask) for k in names], names)


def _compare_block(pdf):
    """Links between members of different components; once two components are
    linked here, their other pairs are left out."""
    import pandas as pd
    pdf = pdf.drop_duplicates(["rep", "shingles"]).sort_values("rep").reset_index(drop=True)
    sets = [np.frombuffer(x, U) for x in pdf["shingles"]]
    sizes = np.array([len(s) for s in sets])
    comp, side, rep = pdf["comp"].to_numpy().copy(), pdf["side"].to_numpy(), pdf["rep"].to_numpy()
    every, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[inverse] > 1
    order = np.argsort(inverse[shared], kind="stable")
    owners = owner[shared][order]
    begin = np.concatenate(([0], np.cumsum(count[count > 1])))
    position = np.cumsum(count > 1) - 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    found = []
    for i in range(len(sets)):
        other = (comp != comp[i]) & ((side != side[i]) | (side == 2))
        other[: i] = False
        if not other.any():
            continue
        own = inverse[at[i]: at[i + 1]]
        own = position[own[count[own] > 1]]
        if not len(own):
            continue
        lengths = begin[own + 1] - begin[own]
        idx = np.repeat(begin[own] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        both = np.bincount(owners[idx], minlength=len(sets))
        hit = np.flatnonzero(other & (both > 0) & (100 * both >= 75 * (sizes + sizes[i] - both)))
        for j in hit:
            if comp[j] != comp[i]:
                found.append((rep[i], rep[j]))
                comp[comp == comp[j]] = comp[i]
    return pd.DataFrame(found, columns=["u", "v"]).astype("int64")


def _candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the wanted ids, from their texts."""
    texts = docs.join(wanted, "doc_id", "left_semi").mapInArrow(_blobs, "doc_id long, shingles binary")
    return stage(texts, "jaccard-blobs")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id
    reachable over links)."""
    docs = id_text(df, id_col, text_col)
    sets = stage(docs.mapInArrow(_features, _FEATURES), "jaccard-sets")
    usable = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    named = docs.where("doc_id IS NOT NULL")

    # equal sets: one representative each
    same = stage(usable.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
                 .where("rep < last").drop("last"), "jaccard-same")
    member = usable.join(same, ["f1", "f2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    member = stage(member, "jaccard-members")

    # signature groups of more than one row
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(named))
    rows = named.mapInArrow(_emit(common), "sig long, ref long")
    from pyspark.sql import Window
    w = Window.partitionBy("sig")
    shared = stage(rows.select("sig", "ref", F.min("ref").over(w).alias("lo"), F.max("ref").over(w).alias("hi"))
                   .where("lo < hi").select("sig", "ref"), "jaccard-shared")
    del rows
    groups = stage(shared.join(member.select(F.col("doc_id").alias("ref"), "rep", "n_shingles"), "ref")
                   .groupBy("sig", "rep").agg(F.min("n_shingles").alias("n"), F.max("n_shingles").alias("nx")), "jaccard-groups")

    # star: every member against the smallest one; an id with several texts has sizes n to nx
    head = stage(groups.groupBy("sig").agg(F.min(F.struct("rep", "n", "nx")).alias("h"), F.max("rep").alias("last"))
                 .where("h.rep < last").select("sig", F.col("h.rep").alias("head"), F.col("h.n").alias("hn"), F.col("h.nx").alias("hx")), "jaccard-heads")
    star = stage(groups.join(head, "sig").where("rep > head AND 4 * nx >= 3 * hn AND 4 * hx >= 3 * n")
                 .select(F.col("head").alias("u"), F.col("rep").alias("v")).distinct(), "jaccard-star")
    # of rows that share an id any sketch may be the one that links
    sketches = sets.where("doc_id IS NOT NULL AND n_shingles > 0").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch")
    star = (star.join(sketches.toDF("v", "nv", "sv"), "v").join(sketches.toDF("u", "nu", "su"), "u")
            .mapInArrow(_sift, "u long, v long"))
    star = stage(star.distinct(), "jaccard-sifted")
    blobs = _candidate_sets(named, star.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    pairs = (star.join(blobs.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b")), "v")
             .join(blobs.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a")), "u"))
    links = stage(pairs.select("u", "v", "a", "b").mapInArrow(_verify, "u long, v long"), "jaccard-links")
    dup = member.where("rep <> doc_id").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    label = stage(connected_components(links), "jaccard-labels")

    # groups that still hold several components
    tagged = groups.join(label.withColumnRenamed("v", "rep"), "rep", "left").select("sig", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
    tagged = stage(tagged, "jaccard-tagged")
    open_groups = (tagged.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"),
                                             F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"))
                   .where("m > 2 AND c0 < c1").groupBy("who", "m").agg(F.min("sig").alias("sig")))
    open_groups = stage(open_groups.select("sig", "m"), "jaccard-open")
    if open_groups.limit(1).count():
        rest = (tagged.join(open_groups, "sig")
                .withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
                .withColumn("blk", F.pmod(F.xxhash64("rep", "sig"), F.col("nb")).cast("int"))
                .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
                .select("sig", "rep", "comp", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"),
                        F.when(F.col("nb") == 1, 2).when(F.col("blk") < F.col("o"), 0).when(F.col("blk") > F.col("o"), 1).otherwise(2).alias("side")))
        rows = (rest.join(sketches, "rep").repartition("sig", "bi", "bj").sortWithinPartitions("sig", "bi", "bj")
                .mapInArrow(_possible, "sig long, bi int, bj int, rep long, comp long, side int"))
        close = stage(rows.distinct(), "jaccard-close")
        # blocks that came down to the same members are one
        once = (close.groupBy("sig", "bi", "bj").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("rep", "side").cast("decimal(38,0)")).alias("who"))
                .groupBy("m", "who").agg(F.min(F.struct("sig", "bi", "bj")).alias("k")).select("k.*"))
        close = stage(close.join(once, ["sig", "bi", "bj"]), "jaccard-close-once")
        sets2 = _candidate_sets(named, close.select(F.col("rep").alias("doc_id")).distinct())
        more = (close.join(sets2.withColumnRenamed("doc_id", "rep"), "rep")
                .groupBy("sig", "bi", "bj").applyInPandas(_compare_block, "u long, v long"))
        links2 = stage(more, "jaccard-links2")
        old = label.select(F.col("comp").alias("u"), "v")
        label = stage(connected_components(old.unionByName(links2).unionByName(dup)), "jaccard-labels2")
    else:
        label = stage(connected_components(label.select(F.col("comp").alias("u"), "v").unionByName(dup)), "jaccard-labels2")
    return (sets.join(label.select(F.col("v").alias("doc_id"), "comp"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id")))
