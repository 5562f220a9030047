"""papyra: PDF-corpus analytics on Spark."""
