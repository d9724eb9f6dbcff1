"""Operators for building training corpora; nothing else in the library imports them.

Functions that run in tasks travel with the job, so that executors need the third-party
packages only, not this one.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
