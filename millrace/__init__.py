"""millrace: a PySpark-native engine that turns scraped organisation pages and profile snapshots into people tables."""
