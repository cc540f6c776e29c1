"""Operators on tables of alleles: summaries, relations, classes, differences."""
