"""codeloom: Spark-native analytics over source-code corpora.

A corpus of source files is a DataFrame. Metadata extraction, dependency
edges, prompt assembly, control-flow path cover, retry-log replay and
object-table change logs are DataFrame -> DataFrame operators.
"""

import sys as _sys

# Functions that run in Python workers (parsers, cover, stream state) are
# shipped by value, so executors need neither an installed package nor the
# driver's sys.path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to by-reference
    pass

from codeloom.session import get_spark, checkpoint_dir, read_table  # noqa: E402

__all__ = ["get_spark", "checkpoint_dir", "read_table"]
