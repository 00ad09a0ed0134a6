"""codelens: Spark jobs that check declared industry codes against company text."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python code shipped to executors (the pandas block step of the neighbour
# search) is pickled by value, so workers need no installed copy of this
# package: the job runs wherever the driver can import it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
