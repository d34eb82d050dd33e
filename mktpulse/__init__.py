"""mktpulse: e-commerce marketing analytics as Spark DataFrame operators.

Every operator is a pure function ``DataFrame... -> DataFrame`` built from
Spark's own expressions (no actions, no driver round trips), so Catalyst plans
each mart end to end. See README.md for the operator map.
"""

__version__ = "0.1.0"
