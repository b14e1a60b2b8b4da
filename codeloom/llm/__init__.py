"""Training-data operators: tokenising, deduplication, classifiers, scans, packing.

Every operator is a DataFrame -> DataFrame function.  ``queries.py`` registers
one thin query per operator; nothing outside this subpackage imports it.
"""
