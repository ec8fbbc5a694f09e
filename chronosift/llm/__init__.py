"""Operators for large training-data corpora.

Every operator takes a DataFrame with at least `doc_id` (integer) and `text`
(string; null counts as empty) unless it says otherwise, ignores further
columns, and works on all rows and whole texts.
"""
