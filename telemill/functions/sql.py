"""Building SQL expression text.

Long expressions are given to Spark as text: one call to the JVM each, where a chain of column
functions takes one call per step.
"""


def quoted(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(identifier: str) -> str:
    """A quoted identifier."""
    return "`" + identifier.replace("`", "``") + "`"


def one_of(expression: str, values) -> str:
    return f"{expression} IN ({', '.join(quoted(v) for v in values)})"


def lookup(expression: str, results: dict[str, str], otherwise: str = "NULL") -> str:
    """A CASE on equality; the results are expressions."""
    if not results:
        return otherwise
    arms = " ".join(f"WHEN {quoted(key)} THEN {result}" for key, result in results.items())
    return f"CASE {expression} {arms} ELSE {otherwise} END"
