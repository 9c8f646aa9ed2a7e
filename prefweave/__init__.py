"""Preference-data curation and evaluation on Spark DataFrames."""
