"""Readers of localisation files: each turns (doc_id, content) rows into string units or template segments."""
