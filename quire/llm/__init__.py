"""Operators that prepare text for training large language models.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries if it is there.
"""
