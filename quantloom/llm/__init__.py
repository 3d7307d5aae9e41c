"""Training-data operators over documents and conversations.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns DataFrames; ``queries.py`` derives the registered digests.
"""
