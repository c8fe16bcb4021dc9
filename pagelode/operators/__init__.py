"""DataFrame operators: chunking, search, incremental maintenance, navigation, the work ledger."""
