"""Evaluation data on Spark: splits, decontamination, readout, scoring, comparison and gates."""

import sys

from pyspark import cloudpickle

from weighbridge.session import configure

# The few Python helpers travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["configure"]
