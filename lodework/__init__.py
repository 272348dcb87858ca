"""lodework: DataFrame operators for analytics on Spark.

Operators are plain functions from DataFrame to DataFrame.  ``plans`` holds one
registered query per operator, with an independent SQL text where SQL can say it.
"""

import sys

from pyspark import cloudpickle

from lodework.session import build_session, load_tables

# Functions of this package travel to the Python workers whole, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "load_tables"]
