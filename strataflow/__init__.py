"""An analytics engine on Spark: relational operators, functions, sources and streams, declared for Catalyst."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions sent to them carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
