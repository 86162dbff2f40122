"""Offline message triage and training-data preparation on Spark DataFrames."""
