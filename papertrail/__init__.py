"""A document analytics engine on PySpark: extraction, classification, search, intents, checklists, photos, ingest."""
