"""savora: review-driven recommendation jobs expressed as PySpark DataFrame operators."""
