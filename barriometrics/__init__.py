"""Rental-listing analytics expressed as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its few Python functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
