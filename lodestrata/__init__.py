"""lodestrata: versioned key/value, document, relational and full-text data on PySpark."""
