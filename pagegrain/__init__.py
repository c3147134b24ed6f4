"""Web-document analytics on Spark."""
