"""End-to-end plans: the scorer (M8), sentence mode (M9) and the registered queries."""
