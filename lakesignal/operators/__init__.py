"""Single operators over DataFrames."""
