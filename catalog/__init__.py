"""The checked queries: library operators applied to the test tables, and the same results as SQL."""
