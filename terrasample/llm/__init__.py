"""Training-data operators: mixing, extraction, de-duplication, classifiers,
pseudonyms, URL rules, token shards and decontamination.

Nothing outside this subpackage imports it.  The queries and their SQL are in
:mod:`terrasample.llm.queries`.
"""
