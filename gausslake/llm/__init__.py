"""Training-data operators: de-duplication, extraction, search, scoring, packing and counting.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library whole.
"""
