"""Readers that turn databases, dump scripts, key dumps and history files into DataFrames."""
