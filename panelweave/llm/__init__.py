"""Training-data operators; nothing outside this folder, corpus_pipeline.py and the entry file imports it."""
