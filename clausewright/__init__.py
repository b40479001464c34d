"""Analytics over contract documents, as lazy operators from DataFrame to DataFrame."""
