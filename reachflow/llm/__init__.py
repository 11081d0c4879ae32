"""Operators of a training-data pipeline: text, tokens, media, sketches and models over documents."""
