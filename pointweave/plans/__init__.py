"""Registered queries: operators applied to the stored tables, each with its SQL twin where one exists."""
