"""CSV ingest: header + inferred types, the wide missing-token set, duplicate
header names made unique the pandas way (a, a.1, a.2); a row with fewer fields
than the header is padded with missing values, a row with more fails.

Files are split between tasks, also where quoted fields hold line breaks.  A
line turns the state at its start (inside or outside a quoted field) into the
state at its end, so a split is a function of two states, known from one pass;
the functions of a file's splits, applied one after another, give the state at
each split's start.  A second pass then joins lines to records in every split
at once, and records that cross a split's end are joined from their pieces.
"""

from __future__ import annotations

import csv as _csv
import io
import re
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.parse import parse_num
from tablewright.operators.stats import agg_chunks
from tablewright.schema import normalise_nulls
from tablewright.session import ship_by_value
from tablewright.staging import staged

ship_by_value(sys.modules[__name__])


def unique_names(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            seen[n] += 1
            cand = f"{n}.{seen[n]}"
            while cand in seen:
                seen[n] += 1
                cand = f"{n}.{seen[n]}"
            seen[cand] = 0
            out.append(cand)
        else:
            seen[n] = 0
            out.append(n)
    return out


# Shapes that decide a column's type.
_INT, _DATE = r"^\s*[+-]?[0-9]{1,38}\s*$", r"^\d{4}-\d{2}-\d{2}$"
_STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?$"


#: The types a text can have, each a bit: a column's types are what all its values share.
_KINDS = ["int", "long", "whole", "number", "boolean", "date", "timestamp"]


def _kinds(c: Column, typed_dates: bool) -> Column:
    """The types of one text, as a sum of bits."""
    bit = lambda ok, kind: F.when(ok, 1 << _KINDS.index(kind)).otherwise(0)
    whole = F.trim(c)
    kinds = (F.when(c.rlike(_INT), bit(whole.try_cast("int").isNotNull(), "int") + bit(whole.try_cast("long").isNotNull(), "long")
                    + (1 << _KINDS.index("whole")) + (1 << _KINDS.index("number")))
             .when(F.lower(c).isin("true", "false"), 1 << _KINDS.index("boolean")))
    if typed_dates:
        kinds = kinds.when(c.rlike(_DATE), bit(c.try_cast("date").isNotNull(), "date")).when(c.rlike(_STAMP), bit(c.try_cast("timestamp").isNotNull(), "timestamp"))
    return kinds.otherwise(bit(parse_num(c).isNotNull(), "number"))


def _inferred(texts: DataFrame, names: list[str], path: str, typed_dates: bool) -> dict[str, Column]:
    """One aggregate over all columns as text: the type that every value of a
    column has, as a typed expression.  Columns without a value are double."""
    cols = {i: F.col(f"_c{i}") for i in range(len(names))}
    aggs = [F.count_if(F.col(f"_c{len(names)}").isNotNull()).alias("extra")]
    aggs += [F.bit_and(F.when(c.isNotNull(), _kinds(c, typed_dates))).alias(f"k{i}") for i, c in cols.items()]
    row = agg_chunks(texts, aggs)
    if row["extra"]:
        raise ValueError(f"{path}: {row['extra']} rows have more fields than the header ({len(names)})")
    typed = {"int": lambda c: F.trim(c).cast("int"), "long": lambda c: F.trim(c).cast("long"),
             "whole": lambda c: F.trim(c).cast("decimal(38,0)"),  # a double would make different ids equal
             "number": parse_num, "boolean": lambda c: c.cast("boolean"), "date": lambda c: c.cast("date"), "timestamp": lambda c: c.cast("timestamp")}
    out = {}
    for i, c in cols.items():
        shared = [k for j, k in enumerate(_KINDS) if (row[f"k{i}"] or 0) >> j & 1]
        out[names[i]] = c.cast("double") if row[f"k{i}"] is None else typed[shared[0]](c) if shared else c
    return out


# ---- records that hold line breaks ---------------------------------------------

# A whole field: without quotes at its start, or quoted (quotes inside doubled).
_FIELD = r'(?:[^",][^,]*+|"(?:[^"]++|"")*+"[^,]*+|)'
#: A line that starts outside a quoted field and ends inside one.
_LEFT_OPEN = rf'^(?:{_FIELD},)*+"(?:[^"]++|"")*+\z'
_OPEN, _CLOSE = re.compile(_LEFT_OPEN.replace(r"\z", r"\Z")), re.compile(r'(?:[^"]++|"")*+"[^,]*+')


def _inside_after(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted field."""
    if inside:
        closed = _CLOSE.match(line)
        if not closed:
            return True
        line = line[closed.end() + 1:]
    return '"' in line and _OPEN.match(line) is not None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(batches):
    """Parts of the batches that lie in one split: (file, block, lines)."""
    for batch in batches:
        file, block = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1, [batch.num_rows]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if hi > lo:
                yield batch.column(0)[lo].as_py(), batch.column(1)[lo].as_py(), batch.column(2).slice(lo, hi - lo)


def _split_states(batches):
    """Per split: the state at its end if it starts outside, and if inside."""
    ends: dict = {}
    for file, block, lines in _by_split(batches):
        state = ends.setdefault((file, block), [False, True])
        for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
            state[:] = [_inside_after(line, s) for s in state] if state[0] != state[1] else [_inside_after(line, state[0])] * 2
    rows = [(f, b, *s) for (f, b), s in ends.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "block", "from_outside", "from_inside"])


def _join_lines(batches, starts: dict):
    """Lines to records.  kind 0: a whole record; 1: the start of a split up to
    the end of a record that began before; 2: a record that the split's end cuts.
    A file's first record, the header, is left out."""
    now, inside, held, kind, header = None, False, [], 0, False

    def cut(records, kinds, file, block):
        return pa.RecordBatch.from_arrays([pa.array([file] * len(records)), pa.array([block] * len(records), pa.int64()), pa.array(kinds, pa.int32()), pa.array(records, pa.string())],
                                          ["file", "block", "kind", "value"])

    for file, block, lines in _by_split(batches):
        records, kinds = [], []
        if (file, block) != now:
            if held:
                yield cut(["\n".join(held)], [kind if kind == 1 else 2], *now)
            if block not in starts.get(file, ()):
                raise RuntimeError(f"{file}: the file was split otherwise in the first pass; read it again")
            now, inside, held = (file, block), starts[file][block], []
            kind, header = 1 if inside else 0, block == 0
        texts = lines.to_pylist()
        at = 0
        for i in np.append(np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)), len(texts)).tolist():
            # lines without a quote don't change the state
            if i > at:
                if inside:
                    held += texts[at:i]
                else:
                    records += texts[at:i]
                    kinds += [0] * (i - at)
            if i < len(texts):
                held.append(texts[i])
                inside = _inside_after(texts[i], inside)
                if not inside:
                    records.append("\n".join(held))
                    kinds.append(kind)
                    held, kind = [], 0
            at = i + 1
        if records and header:
            records, kinds, header = records[1:], kinds[1:], False
        if records:
            yield cut(records, kinds, file, block)
    if held:
        yield cut(["\n".join(held)], [kind if kind == 1 else 2], *now)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): one row per record, quoted line breaks included;
    reaches the driver: two states for each split of the files."""
    lines = _lines(spark, path)
    states = lines.mapInArrow(_split_states, "file string, block long, from_outside boolean, from_inside boolean").collect()
    starts: dict = defaultdict(dict)
    for r in sorted(states, key=lambda r: (r["file"], r["block"])):
        of = starts[r["file"]]
        before = of.get("next", False)
        of[r["block"]], of["next"] = before, r["from_inside"] if before else r["from_outside"]
    starts = dict(starts)
    cut = staged(lines.mapInArrow(lambda batches: _join_lines(batches, starts), "file string, block long, kind int, value string"), "csv-records")
    begun = F.sum((F.col("kind") == 2).cast("long")).over(Window.partitionBy("file").orderBy("block", "kind"))
    pieces = cut.where("kind > 0").withColumn("record", begun)
    joined = pieces.groupBy("file", "record").agg(F.min("block").alias("block"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "value"))), lambda p: p["value"]), "\n").alias("value"))
    return cut.where("kind = 0").select("file", "block", "value").unionByName(joined.select("file", "block", "value"))


def _header(spark: SparkSession, path: str) -> str:
    """The first record of a file."""
    lines = _lines(spark, path).where("block = 0").select("value")
    n = 1
    while True:
        got = [r[0] for r in lines.limit(n).collect()]
        inside = False
        for i, line in enumerate(got):
            inside = _inside_after(line, inside)
            if not inside:
                return "\n".join(got[: i + 1]).removesuffix("\r")
        if len(got) < n:
            raise ValueError(f"the header of {path} doesn't end" if got else f"empty CSV: {path}")
        n *= 16


def read_csv(spark: SparkSession, path: str, infer_schema: bool = True, multi_line: bool = True, typed_dates: bool = False) -> DataFrame:
    """Fields as text with the missing tokens as null, then typed from one
    aggregate over all rows: int, long, decimal(38,0) for longer integers, double,
    boolean, else text.  Dates stay text, which the audit and the preparation
    look at, unless ``typed_dates``.  Quotes inside quoted fields are doubled; a
    quoted field may hold line breaks (``multi_line``), a quote inside a field
    that doesn't start with one is a character."""
    names = unique_names(next(_csv.reader(io.StringIO(_header(spark, path), newline=""))))
    # one extra text column catches rows with more fields than the header
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names) + 1)])
    options = {"mode": "PERMISSIVE", "quote": '"', "escape": '"', "nullValue": ""}
    broken = multi_line and _lines(spark, path).where(F.contains("value", F.lit('"')) & F.col("value").rlike(_LEFT_OPEN)).limit(1).count() > 0
    if broken:
        value = F.regexp_replace("value", r"\r\z", "")
        fields = ", ".join(f"{f.name} string" for f in schema)
        raw = _records(spark, path).where(F.trim(value) != "").select(F.from_csv(value, fields, options).alias("r")).select("r.*")
    else:
        raw = spark.read.schema(schema).options(**options).option("header", True).option("enforceSchema", True).csv(path)
    texts = normalise_nulls(raw)
    if not infer_schema:
        return texts.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
    return texts.select(*[e.alias(n) for n, e in _inferred(texts, names, path, typed_dates).items()])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
