"""Spark-native analytics: event features, screens, evaluation, drift, segments and forecasts as DataFrame operators."""
