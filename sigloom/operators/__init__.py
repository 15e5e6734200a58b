"""Single steps: DataFrame in, DataFrame out, no action inside."""
