"""Registered queries and the SQL they are held against."""

#: Modules of this package that hold a registry R.
FAMILIES = ["general", "analytics", "text", "graph", "retrieval", "maintenance", "pipelines", "tools"]
