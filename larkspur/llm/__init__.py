"""Training-data operators: fingerprints, secrets, search, tokens, packing, dedup, language, HTML, toxicity.

Nothing outside this subpackage imports it.
"""
