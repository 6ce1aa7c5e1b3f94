"""Operators for preparing training data. Nothing outside this subpackage imports it."""

from pyspark import cloudpickle

import molsurf.llm as _self

# Executors need no copy of this package: functions travel with the job.
cloudpickle.register_pickle_by_value(_self)
