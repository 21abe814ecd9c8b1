"""Merchant revenue analytics as PySpark DataFrame operators.

Every operator is a lazy ``DataFrame -> DataFrame`` function; no module creates
a session or collects rows.  See README.md for the map of the package.
"""
