"""Graph operators: every one maps DataFrames to a DataFrame with a fixed schema."""
