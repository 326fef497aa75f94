"""Streams: the hash-chained log, the running budget, and an index that follows the files of a tree."""
