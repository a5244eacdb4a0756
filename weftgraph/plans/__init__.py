"""Building blocks shared by the operators: durable intermediates, fixpoints, skew control."""
