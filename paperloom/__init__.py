"""Document classification, invoice field extraction and model evaluation as Spark DataFrame jobs."""
