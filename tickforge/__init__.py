"""Market-microstructure feature engine on Spark: order events and book snapshots to training datasets."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
