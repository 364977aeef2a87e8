"""kpiforge: retail and e-commerce analytics as lazy Spark DataFrame operators.

Every operator takes DataFrames (and plain parameters) and returns a lazy
DataFrame built from native Spark expressions, so Catalyst plans it and the
cluster runs it.  Sub-packages:

* ``functions``  column-level helpers (column mapping, rounding, periods, text)
* ``sources``    readers, writers, the synthetic ledger, driver-table views
* ``operators``  the analytics operators (sales, segments, forecasts, ...)
* ``plans``      multi-output bundles and the query catalogue
* ``llm``        training-data operators (a package of its own)
"""

from kpiforge.functions.columns import ColumnMap, DEFAULT_COLUMNS  # noqa: F401
from kpiforge.session import get_session  # noqa: F401

__version__ = "0.1.0"
