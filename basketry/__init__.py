"""Index replication and factor-portfolio analytics as Spark jobs on long tables."""
