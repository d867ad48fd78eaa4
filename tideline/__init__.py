"""Environmental-trend analytics as composable Spark DataFrame operators."""
