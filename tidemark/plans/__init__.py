"""Read models and audits composed from the operators, and the registered queries."""
