"""Operators on DataFrames: selection, metrics, inference, simulation, models, texts and embeddings."""
