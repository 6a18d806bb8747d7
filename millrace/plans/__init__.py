"""Whole queries over the tables, with the SQL that gives the same rows."""
