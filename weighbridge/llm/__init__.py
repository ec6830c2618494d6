"""Operators of a training-data pipeline: dedup, decontamination, privacy, tokens, language, quality, shards, secrets, chat.

Nothing outside this folder imports it.
"""
