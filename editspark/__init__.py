"""A PySpark-native engine for semi-structured text editing: parsing, retrieval, routing, rendering and scoring of reports."""
