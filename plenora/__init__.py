"""plenora: a PySpark-native analytics library for speaker-attributed speech and text corpora.

Every operator is a plain ``DataFrame -> DataFrame`` function (or a builder of
``Column`` expressions); nothing here starts jobs or owns a session unless the
docstring says so.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
