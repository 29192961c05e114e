"""Parapheur: document analytics on PySpark for OCR output of administrative letters."""
