"""Registered queries: operators bound to the sample tables, with the SQL that states the same result."""
