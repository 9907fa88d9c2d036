"""Linking and deduplicating records across product catalogues, planned as Spark DataFrame operators."""
