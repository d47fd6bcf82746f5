"""tablewise: profile, audit, summarise and star-schema-ise flat tables on Spark."""
