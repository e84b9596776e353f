"""Query plans: the adapter over the event stream, the dashboard, the management calls."""
