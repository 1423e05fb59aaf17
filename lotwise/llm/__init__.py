"""Operators for preparing large text corpora.  Nothing else in ``lotwise`` imports this subpackage."""
