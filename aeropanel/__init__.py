"""Forecast-evaluation analytics as Spark DataFrame operators over long, keyed relations."""
