"""Named HTML character references understood by the entity decoder.

Built from a rule rather than typed out: the HTML 4 name table that ships
with Python's standard library, plus ``apos``.
"""

from __future__ import annotations

from html.entities import name2codepoint


def entity_table() -> dict[str, str]:
    table = {name: chr(cp) for name, cp in name2codepoint.items()}
    # Fixed value: the XML apostrophe reference, also decoded.
    table["apos"] = "'"
    return table
