"""Text -> number and text -> timestamp parsers.

Semantics follow pandas' ``to_numeric(errors="coerce")`` and
``to_datetime(errors="coerce", format="mixed")`` as closely as a fixed list of
layouts allows.  Spark's casts are more permissive than pandas in a few places
(``1d`` is a double, any 4-digit number is a year, ``10:30`` and ``now`` are
timestamps), so every parse is gated by a regular expression first.  All of it
is built-in expressions; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted number syntax (sign, digits with optional point,
# optional exponent, or inf/infinity), surrounding blanks allowed.
NUM_PATTERN = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"

# Date layouts tried in order (Spark datetime patterns).  Month
# first before day first, as pandas does for ambiguous slashes.
TS_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy/MM/dd",
    "yyyy/M/d",
    "M/d/yyyy",
    "d/M/yyyy",
    "M-d-yyyy",
    "d.M.yyyy",
    "MMM d yyyy",
    "MMM d, yyyy",
    "MMMM d yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "yyyyMMdd",
    "yyyy-MM",
]

# Bare years accepted, pandas' nanosecond timestamp range.
YEAR_MIN, YEAR_MAX = 1678, 2261

# Layouts by the shape of the text.  A shape has one parse, two
# where day and month can change places; an empty list is the built-in cast,
# which reads ISO times with fractions and zones.  Shapes with month names are
# compared with the first letter in upper case.
_TIME = r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
_CLOCK = r"( \d{1,2}:\d{2}(:\d{2})?)?"
TS_SHAPES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ["yyyy-M-d"]),
    (r"^\d{4}-\d{1,2}-\d{1,2}" + _TIME + r" ?(Z|UTC|[+-]\d{2}:\d{2})?$", []),
    (r"^\d{4}/\d{1,2}/\d{1,2}" + _CLOCK + "$", ["yyyy/M/d[ H:mm[:ss]]"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}" + _CLOCK + "$", ["M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}" + _CLOCK + "$", ["M-d-yyyy[ H:mm[:ss]]", "d-M-yyyy[ H:mm[:ss]]"]),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}" + _CLOCK + "$", ["M.d.yyyy[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]"]),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", ["MMM d[,] yyyy"]),
    (r"^[A-Za-z]{4,9} \d{1,2},? \d{4}$", ["MMMM d[,] yyyy"]),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", ["d MMM yyyy"]),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", ["d MMMM yyyy"]),
    (r"^\d{4}-\d{2}$", ["yyyy-MM"]),
]

# A value is considered only if it holds a 4-digit year and nothing but
# date-ish characters; this rejects clock-only values (10:30), words (now,
# today) and short numbers (12).
_TS_GATE = r"^\s*[0-9A-Za-z ,./:\-]*[0-9]{4}[0-9A-Za-z ,./:\-]*\s*$"
_BARE_YEAR = r"^\s*[0-9]{4}\s*$"
_BARE_DIGITS = r"^\s*[0-9]+\s*$"
_EIGHT_DIGITS = r"^\s*[0-9]{8}\s*$"


def parse_num(c: Column) -> Column:
    """Text -> double, null when the text is not a plain number."""
    s = c.cast("string")
    return F.when(s.rlike(NUM_PATTERN), _try_double(F.trim(s)))


def _try_double(s: Column) -> Column:
    return s.try_cast("double")


def _ts_with(s: Column, fmt: str) -> Column:
    return F.try_to_timestamp(s, F.lit(fmt))


def parse_ts(c: Column, formats: list[str] | None = None) -> Column:
    """Text -> timestamp, layout chosen per value by the shape of the text (or, with
    ``formats``, the first of those that parses)."""
    s = F.trim(c.cast("string"))
    year = F.when(s.rlike(_BARE_YEAR), s.try_cast("int"))
    out = F.when(s.rlike(_BARE_YEAR), F.when(year.between(YEAR_MIN, YEAR_MAX), _ts_with(s, "yyyy"))) \
           .when(s.rlike(_EIGHT_DIGITS), _ts_with(s, "yyyyMMdd")).when(s.rlike(_BARE_DIGITS), F.lit(None).cast("timestamp"))
    if formats is not None:
        return out.when(s.rlike(_TS_GATE), F.coalesce(*[_ts_with(s, f) for f in formats if f != "yyyyMMdd"]))
    for shape, layouts in TS_SHAPES:
        text = F.initcap(s) if "A-Z" in shape and "UTC" not in shape else s
        out = out.when(s.rlike(shape), F.coalesce(*[_ts_with(text, f) for f in layouts]) if layouts else s.try_cast("timestamp"))
    return out


def pick_ts_format(sample: str | None) -> str | None:
    """Driver-side: first layout that parses one sample value (pure Python,
    used to choose a single layout for a whole column, as a profiler does)."""
    if sample is None:
        return None
    import datetime as _dt
    py = {
        "yyyy": "%Y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "M": "%m", "dd": "%d",
        "d": "%d", "HH": "%H", "mm": "%M", "ss": "%S", "SSSSSS": "%f", "'T'": "T",
    }
    import re as _re
    text = sample.strip()
    if _re.fullmatch(r"[0-9]{4}", text) and YEAR_MIN <= int(text) <= YEAR_MAX:
        return "yyyy"
    for f in TS_FORMATS:
        pf = _re.sub(r"'T'|yyyy|MMMM|MMM|MM|M|dd|d|HH|mm|SSSSSS|ss",
                     lambda m: py[m.group(0)], f)
        try:
            _dt.datetime.strptime(text, pf)
            return f
        except ValueError:
            continue
    return None


def coerce_datetime_candidates(df, order_by: list[str], threshold: float = 0.8):
    """Profile-style date coercion: per text column, one layout chosen from its
    first non-null value (by ``order_by``); when at least ``threshold`` of the
    non-null values parse with it, the column becomes a timestamp.

    Two small jobs: one ordered ``first`` per column, one parse-count pass."""
    from pyspark.sql import types as T
    from tablewright.schema import q
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    firsts = df.agg(*[F.min_by(F.col(q(c)), F.when(F.col(q(c)).isNotNull(),
                                                    F.struct(*[F.col(q(k)) for k in order_by])))
                      .alias(f"f{i}") for i, c in enumerate(texts)]).collect()[0]
    fmts = {c: pick_ts_format(firsts[f"f{i}"]) for i, c in enumerate(texts)}
    cand = {c: f for c, f in fmts.items() if f}
    if not cand:
        return df
    names = list(cand)
    row = df.agg(*[F.count(F.col(q(c))).alias(f"n{i}") for i, c in enumerate(names)],
                 *[F.count(_ts_with(F.trim(F.col(q(c))), cand[c])).alias(f"p{i}") for i, c in enumerate(names)]
                 ).collect()[0]
    chosen = {c for i, c in enumerate(names) if row[f"n{i}"] and row[f"p{i}"] / row[f"n{i}"] >= threshold}
    return df.select(*[(_ts_with(F.trim(F.col(q(c))), cand[c]) if c in chosen else F.col(q(c))).alias(c)
                       for c in df.columns])
