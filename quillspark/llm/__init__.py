"""Operators for preparing large text corpora for language-model training."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so a cluster need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
