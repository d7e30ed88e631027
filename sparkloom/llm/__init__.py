"""Operators for preparing large training corpora; self-contained, nothing else imports them."""

import sys

from pyspark import cloudpickle

# Worker code of this subpackage travels with the task, so executors need no copy on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
