"""The position-integrity operators; each is a function of DataFrames and explicit parameters."""
