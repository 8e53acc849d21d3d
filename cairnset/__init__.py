"""Finding triage and training-data preparation as plain Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames; nothing is collected
unless a docstring says so and names the bound.
"""

__version__ = "0.1.0"
