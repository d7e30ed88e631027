"""Analytics over text and source-code corpora, usage logs and link graphs, as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
