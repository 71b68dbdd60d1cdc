"""Helpers shared by the operators: folds and lineage cutting."""
