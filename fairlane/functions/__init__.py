"""Column-level functions: engineered features, decoders, decisions, record
validation and rule-based reasons. All are built-in Spark expressions."""
