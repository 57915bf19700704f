"""Tablewright: document-table structuring, verification and repair as Spark DataFrame operators."""
