"""Readers and writers: delimited text, path-keyed files, report files, bundles."""
