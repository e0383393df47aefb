"""ballast: railway operations analytics as PySpark DataFrame and streaming operators."""
