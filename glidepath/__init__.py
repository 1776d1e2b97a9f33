"""Arrival analytics for moving-object position reports, as Spark DataFrame functions."""
