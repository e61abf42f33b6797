"""Operators for preparing language-model training data at scale.

Nothing outside this package imports it; its queries are in ``queries``.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package: its functions travel with the jobs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
