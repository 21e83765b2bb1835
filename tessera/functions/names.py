"""Column names in expressions."""


def q(c: str) -> str:
    """A column name as one identifier, whatever characters it has."""
    return "`" + c.replace("`", "``") + "`"
