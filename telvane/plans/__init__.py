"""Table views, end-to-end flows and the query catalogue."""
