"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Functions that run inside tasks travel with the task, so executors need numpy, pyarrow and the
tokenizer library but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
