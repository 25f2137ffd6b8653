"""Relational operators over DataFrames; none starts a job unless its name says so."""
