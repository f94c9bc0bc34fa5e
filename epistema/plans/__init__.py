"""Plans that combine operators, and the engine that offers them."""
