"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Its functions are sent
to Python workers by value, so executors need numpy, pyarrow and the tokenizer
libraries, but not this package.
"""

from __future__ import annotations

import sys

from tablewright.session import ship_by_value

ship_by_value(sys.modules[__name__])
