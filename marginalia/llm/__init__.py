"""Training-data operators: toxicity, near-duplicates, language, sharding, licences, leaks, secrets, tokens.

Nothing outside this folder imports it; queries.py lists what __spark_entry__ registers.
"""
