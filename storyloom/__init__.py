"""A PySpark-native engine for news-story analytics and training-data preparation."""
