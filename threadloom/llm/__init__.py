"""Training-data operators: near-duplicate removal, filters, classifiers, mixing, packing.

Nothing outside this subpackage imports it.
"""
