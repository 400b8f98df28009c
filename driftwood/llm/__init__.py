"""Operators for preparing training text: licence scans, language
identification, main-text extraction, byte-level BPE, fingerprints, token
counts, source mixing, near-duplicate and repeated-passage removal, and
vector search.  Nothing else in the library imports this subpackage."""
