"""Training-data operators for text corpora: one module per operator, their registered queries in ``queries``.

Nothing else in the library imports this subpackage. Functions that run on executors travel by value, so a cluster needs no
installed copy of the library.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["cytomosaic"])
