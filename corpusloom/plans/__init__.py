"""Configuration, whole plans and the registered queries."""
