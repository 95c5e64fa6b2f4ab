"""Whole plans: the record views of the tables, the queries, and the experiments."""
