"""Facts derived from star-schema tables, registered queries and their SQL."""
