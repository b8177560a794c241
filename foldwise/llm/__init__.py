"""Operators for preparing training data of language models.

Nothing else in the package imports this subpackage.  Every operator takes and
returns DataFrames; Python runs inside tasks through Arrow, on partitions that
Spark has dealt out.
"""
