"""SQL statements as text."""
from __future__ import annotations


def bare_statement(query: str) -> str:
    """The statement without the blanks around it and the semicolons, any number of them, that end it."""
    end = len(query)
    while end and (query[end - 1] == ";" or query[end - 1].isspace()):
        end -= 1
    return query[:end].lstrip()
