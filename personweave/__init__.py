"""personweave: record fusion for profile data, planned as DataFrame and SQL expressions."""
