"""Continuous form: completions in, scored rows out, history appended once."""
