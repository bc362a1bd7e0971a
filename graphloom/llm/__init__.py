"""Operators on text and source code for training data. Nothing else in the library imports this subpackage."""
