"""Training-data operators: de-duplication, classification, decontamination, PII, filtering, packing.

Every operator takes DataFrames and returns a DataFrame; ``queries.QUERIES`` holds the thin
``opN_*`` queries over the standard tables and ``queries.ORACLE_SQL`` their SQL equivalents.
"""
