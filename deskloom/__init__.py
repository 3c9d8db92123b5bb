"""deskloom: support-desk analytics as composable PySpark DataFrame operators."""
