"""Queries over the test tables, each with SQL for comparison."""
