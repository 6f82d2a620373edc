"""From expressions and statements to Spark columns and DataFrames."""
