"""textguard: screening and cleaning of message tables and streams on Spark."""
