"""Registered queries: each operator applied to its whole tables, beside its SQL."""
