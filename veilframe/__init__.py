"""Personal data in tables of documents: find, review, redact, prove. Spark-native."""
