"""Operators for building training corpora. Nothing outside of this package imports it.

The functions that run in Python workers are shipped by reference: on a cluster, give the package
to the executors with ``--py-files`` or install it there."""
