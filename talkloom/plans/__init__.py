"""Registered queries over the driver's tables, with DuckDB SQL where SQL can express them."""


def load() -> None:
    """Import the modules that register queries."""
    from talkloom.plans import conversation, curate, evaluate, generation, session, surface, text  # noqa: F401
