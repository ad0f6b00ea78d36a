"""Training-data operators: filters, deduplication, decontamination, mixing and sharding.

Nothing outside this subpackage imports it.
"""
