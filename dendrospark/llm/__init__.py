"""Operators of a training-data pipeline: near and exact-substring dedup,
toxicity, language, packing, language-model scores, vector search, sharding
and byte-level BPE."""
