"""lurescope: message-risk analytics as Spark jobs.

Operators take DataFrames and return DataFrames. Nothing in here creates a
session except :mod:`lurescope.session`, which tests and the bench use.
"""

__version__ = "0.1.0"
