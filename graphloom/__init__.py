"""Sequence-graph analytics and columnar codecs on Spark DataFrames."""
