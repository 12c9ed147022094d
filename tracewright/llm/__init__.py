"""Training-data operators: packing, near-duplicates, classifiers, fingerprints, archives, URL rules, decontamination.

Nothing outside this package imports it.
"""
