"""Operators of a training-data pipeline over tables of texts.  Nothing else
in the library imports this package.

Functions of this package travel to the tasks by value, so executors need the
public libraries only, not a copy of this one.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
