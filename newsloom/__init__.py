"""News and text analytics on Spark DataFrames.

Every operator is a plain function ``DataFrame -> DataFrame``; Catalyst picks
the physical plan.  See README.md for the map from operators to modules.
"""
