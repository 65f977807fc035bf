"""Support-conversation analytics expressed as PySpark DataFrame plans."""
