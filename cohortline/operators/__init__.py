"""DataFrame operators: cleaning, quality rules, classification, marts, dashboard, trust checks."""
