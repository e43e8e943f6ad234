"""Rule programs and SQL text to DataFrames."""
