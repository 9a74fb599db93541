"""Operators over DataFrames: folds, merges, feeds, measures, classification, curation."""
