"""Whole chains of operators, the query catalog and its reference SQL."""
