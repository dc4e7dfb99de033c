"""cutflow: time-coded media analytics and corpus preparation as Spark DataFrame operators."""
