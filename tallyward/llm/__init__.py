"""Operators for large-scale training-data pipelines, with their registered queries.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is present.
"""
