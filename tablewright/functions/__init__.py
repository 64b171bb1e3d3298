"""Column-expression builders (all JVM-side, inside whole-stage codegen)."""

from tablewright.functions.parse import parse_num, parse_ts, pick_ts_format, TS_FORMATS  # noqa: F401
from tablewright.functions.scalars import (  # noqa: F401
    clip, date_parts, hist_bin, to_text, residual, slug, band_label,
)
