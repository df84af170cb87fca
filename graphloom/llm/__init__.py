"""Training-data operators: deduplication, filtering, extraction, packing and sharding.

Nothing else in the library imports this subpackage. Each module holds one operator with its
general interface; ``registry`` binds the operators to the whole tables they are meant for.
"""
