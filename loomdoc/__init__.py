"""A document, vector and text analytics engine on PySpark."""
