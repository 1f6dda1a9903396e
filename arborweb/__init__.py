"""arborweb: structured extraction from semi-structured web documents on PySpark."""
