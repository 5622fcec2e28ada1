"""Queries over the fixture tables, and the SQL that they are held against."""
