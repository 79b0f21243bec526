"""Article curation on Spark: DataFrame operators, jobs and one streaming job."""
