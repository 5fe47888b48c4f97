"""Attribute-audit operators for PySpark DataFrames."""
import os

# Tasks already use every core; a threaded BLAS inside them only oversubscribes,
# and its threads do not survive the fork of the Python workers.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")
