"""Whole programs: evaluation sets, dictionaries, synthetic pairs, mixtures."""
