"""DataFrame to DataFrame steps; lazy unless their docstring says otherwise."""
