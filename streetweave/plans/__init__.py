"""Options, the network facade, and the catalogue of queries with their SQL."""
