"""Registered queries: each operator on the supplied tables, with its SQL check."""
