"""Document operators over DataFrames: patches, diffs, replicated documents, types."""
