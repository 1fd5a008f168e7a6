"""Read models, domain views and the registered queries."""
