"""Registered queries: each operator on the shared tables, with its SQL twin where one exists."""
