"""Training-data operators: search, secrets, duplicates, toxicity, packing, encoding, filters, language.

Nothing outside this folder imports it; ``queries`` names what the driver runs.
"""
