"""Whole jobs put together from operators: features, training, evaluation and reports."""
