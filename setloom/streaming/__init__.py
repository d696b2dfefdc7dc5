"""Posting lists kept up to date from a stream."""
