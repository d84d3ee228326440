"""tallyforge: a Spark-native reconciliation and financial-analytics engine."""
