"""Query plans: the SQL front door, the star-schema benchmark, operator queries, workloads."""
