"""Scalar functions: paths, formatting, hashes, codecs."""
