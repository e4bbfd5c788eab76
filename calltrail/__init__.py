"""calltrail: method-trace event analytics as Spark DataFrame / SQL / Streaming jobs.

Subpackages:
  functions  Column -> Column expressions (labels, detail text, masking, names)
  operators  DataFrame -> DataFrame operators (filters, paging, summaries,
             call pairing and trees, governance, insights)
  sources    readers and writers (batches, device logs, sessions, the store)
  streaming  Structured Streaming versions of ingest, follow and live views
  plans      the named query catalogue and its DuckDB oracle SQL
"""

from calltrail.session import get_spark, checkpoint_dir  # noqa: F401
from calltrail.schema import EVENT, conform  # noqa: F401

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel by value, so executors need no
# copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
