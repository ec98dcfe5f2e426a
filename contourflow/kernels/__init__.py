"""Plain numpy algorithms that receive one bounded group."""
