"""Operators of a training-data pipeline: scoring, language, tokens, packing, neighbours, near copies, licences, mixing, URLs."""
