"""Scalar functions over columns: addresses, headers and report texts. Native unless stated."""
