"""tessera: panel (asset x time) analytics expressed with the DataFrame, SQL and Structured Streaming APIs."""
