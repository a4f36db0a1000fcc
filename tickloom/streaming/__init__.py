"""No stream operators: every input of this engine is a finite table of events before one prediction.

The window aggregates of ``operators`` are plain DataFrame functions and take a micro-batch as they take a table.
"""
