"""Operators for preparing language-model training data. Nothing else in kinotable imports this subpackage."""
