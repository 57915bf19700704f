"""Operators for large training-data corpora.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers
:func:`tablewright.llm.registry.queries` when the subpackage can be imported.
"""
