"""tripwire: alerting and reporting over fleet telemetry, written as Spark DataFrame jobs.

Layers:
  sources/    readers for the input tables, telemetry bindings, config tables
  functions/  column-level helpers (formatting, escaping, parsing)
  operators/  DataFrame -> DataFrame building blocks (selection, thresholds, state, routing, rendering)
  plans/      end-to-end alert and report jobs composed from the operators
  streaming/  Structured Streaming drivers for the same jobs
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from tripwire.session import checkpoint_dir, get_spark

# Functions of this package that run in Python workers travel inside the task, so the
# executors need no copy of the package on their path.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark", "checkpoint_dir"]
