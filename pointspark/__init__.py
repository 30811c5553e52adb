"""Point-cloud sequence analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel with their code, so the package need
# not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
