"""Training-data operators: near duplicates, mixing, licenses, quality, decontamination, PII, secrets, exact substrings.

Nothing outside this folder imports it; the rest of the library works without it.
"""
