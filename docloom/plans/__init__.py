"""Plan-time compilers: expressions and paths become Columns and table plans."""
