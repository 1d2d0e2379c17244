"""Research operators on bars, ticks and trades as Spark DataFrame functions."""
