"""Operators for preparing training text: near-duplicates, term counts and weights, rankings,
page cleaning, leak search, source mixing and subject labels."""
