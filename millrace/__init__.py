"""millrace: DataFrame-to-DataFrame operators for semi-structured operational data on Spark."""
