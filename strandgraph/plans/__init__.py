"""The test graph and the registered queries."""
