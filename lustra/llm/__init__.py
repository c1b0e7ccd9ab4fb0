"""Operators for preparing large text corpora: deduplication, language identification,
fingerprints, media, sharding, packing, chat formatting, extraction and mixing.

Nothing outside this subpackage imports it.
"""
