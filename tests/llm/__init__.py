"""Tests of the optional training-data operators."""
