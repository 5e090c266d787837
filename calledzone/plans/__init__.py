"""Jobs a user calls, put together from the operators."""
