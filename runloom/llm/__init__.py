"""Operators for preparing training data: quality, language, duplicates, contamination, tokens, personal data."""

from pyspark import cloudpickle

import runloom

# Python workers get these modules with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(runloom)
