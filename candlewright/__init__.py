"""Spark-native analytics over bar series: conditions, mining, outcomes, costs and reports."""
