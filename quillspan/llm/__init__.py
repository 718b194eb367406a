"""Operators for training-data preparation.  Nothing else in the package imports this subpackage."""
