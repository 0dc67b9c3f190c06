"""Prompt, conversation and corpus analytics expressed as Spark plans."""
