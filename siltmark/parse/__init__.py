"""Lexers and structure builders for source languages, run inside Arrow batches."""
