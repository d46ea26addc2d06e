"""Session helpers, the graph queries, registered queries, command line."""
