"""Training-data operators: quality, dedup, decontamination, mixing, encoding, archives.

Nothing outside this folder imports it; ``queries`` holds the driver's entries.
"""
