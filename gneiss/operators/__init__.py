"""Operators: datasets, word counts, graphs and linear models."""
