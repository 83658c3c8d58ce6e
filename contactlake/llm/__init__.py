"""Operators for preparing training text; nothing outside this folder imports it."""

from pyspark import cloudpickle

import contactlake.llm as _self

# Functions sent to executors travel whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(_self)
