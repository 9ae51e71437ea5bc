"""Operators over series in long form: series_id, pos, value."""
