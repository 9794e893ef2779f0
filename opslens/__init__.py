"""opslens: health reports over fleet-wide operations data, built on Spark DataFrames.

Layout
------
sources/    readers for the raw tables and the logical (snapshot) tables derived from them
functions/  column-expression helpers: code maps, time arithmetic, NULL-safe text
operators/  the report operators, one function DataFrame(s) -> DataFrame each
plans/      plan-shape helpers: size-checked broadcast, skew-safe per-key windows,
            plan inspection, and the registry of named queries
streaming/  Structured Streaming variants that reuse the batch column expressions
"""

__version__ = "0.1.0"
